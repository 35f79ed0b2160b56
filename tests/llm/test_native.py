"""Line dedup and decontamination against plain Python on hand-made tables."""

import re

from bendpoint.llm import decontam, linededup

from .conftest import rows

TABLE = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
LONG = "a line that is long enough to count"


def brute_lines(docs, min_docs=3, min_chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(TABLE)

    low = -(1 << 63)
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        mine = low if i is None else i
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < min_docs or mine == max(holders[key(x)])
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_cases(docs_of):
    docs = [
        (1, f"{LONG}\nown first line of one\n\n"),
        (2, f"  {LONG.upper()}\t\nshort"),
        (3, f"{LONG}\n{LONG}"),
        (5, f"É{LONG}\né{LONG}\nshort\r"),
        (7, f"short\n{LONG} \x0b"),
        (7, f"short\n{LONG} \x0b"),
        (8, None),
        (9, ""),
        (None, f"{LONG}\nx"),
        (4, "\n".join(["twice in one document, but in one"] * 3)),
    ]
    for batches, fanout in ((1, 2), (3, 2), (4, 3)):
        out = linededup.dedup_lines(docs_of(docs), batches=batches, fanout=fanout)
        assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(docs)


def test_line_dedup_counts_across_batches(docs_of):
    docs = [(i, f"line number {i % 7} is found in many documents\nonly in {i} and nowhere else") for i in range(60)]
    out = linededup.dedup_lines(docs_of(docs), batches=5)
    assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(docs)


def test_line_dedup_empty_table_and_clashing_names(docs_of):
    from pyspark.sql import functions as F

    assert linededup.dedup_lines(docs_of([])).count() == 0
    odd = docs_of([(i, LONG) for i in range(3)]).withColumns({"lost": F.lit(1), "doc": F.lit(2), "n_lines": F.lit(9)})
    out = linededup.dedup_lines(odd)
    assert rows(out, "doc_id", "text", "n_lines", "lost", "doc") == [(0, "", 1, 1, 2), (1, "", 1, 1, 2), (2, LONG, 1, 1, 2)]


def brute_hits(docs, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))

    spans = []
    for item, text in items:
        w = words(text)
        spans += [(item, w[i : i + window]) for i in range(max(len(w) - window, 0) + 1)] if w else []
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, span in spans:
            for k in range(len(w) - len(span) + 1):
                if w[k : k + len(span)] == span:
                    hit |= set(range(k, k + len(span)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_cases(spark, docs_of):
    abc = [f"w{i}" for i in range(40)]
    items = [
        (1, " ".join(abc[:25])), (2, " ".join(abc[5:17])), (10, "Short, item!"), (11, "Çà x"), (12, None), (13, "..."),
        (14, "same " * 12), (2, " ".join(abc[5:17])),
    ]
    docs = [
        (1, "x y " + " ".join(abc[3:14]) + " z"),
        (2, " ".join(abc[3:12])),
        (3, "a short ITEM here; short... item"),
        (4, "çà x"),
        (5, "Çà x"),
        (6, "same " * 30),
        (7, None),
        (8, ""),
        (9, " ".join(abc) + " q " + " ".join(abc)),
        (9, " ".join(abc) + " q " + " ".join(abc)),
        (9, "another text of that id with a short item"),
        (None, " ".join(abc[8:30])),
        (11, "short item"),
    ]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontam.decontaminate(docs_of(docs), table)
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == brute_hits(docs, items)


def test_decontamination_random(spark, docs_of):
    import random

    draw = random.Random(5)
    vocabulary = ["a", "b", "c"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([3, 8, 10, 11, 14]))) for i in range(12)]
    docs = [(i, text(draw.randrange(0, 60))) for i in range(40)]
    out = decontam.decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == brute_hits(docs, items)


def test_decontamination_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = decontam.decontaminate(docs_of([(1, "a b")]), none)
    assert rows(out, "doc_id", "n_words", "n_hit", "contaminated") == [(1, 2, 0, False)]
    assert decontam.decontaminate(docs_of([]), none).count() == 0
