import itertools

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit

DOCS = "doc_id long, text string, source string, good string"


def failures(text, doc_id, table):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in table),
    }


def brute(table, labels):
    """Every order run over the documents, filter by filter."""
    said = lambda i, k: any(r[0] == i and r[k] == 1 for r in labels) if i is not None else False
    rows = [(s or "", failures(t or "", i, table), said(i, 1), said(i, 2)) for i, t, s, *_ in table]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[1][letter]]
                left = [r for r in left if not r[1][letter]]
                fails = [r for r in mine if r[1][letter]]
                removals[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(r[1].values()) == 1 for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def plain(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


LONG = " ".join(f"word{k}" for k in range(60))
TABLE = [
    (1, LONG, "a", "x"), (2, LONG, "b", None), (3, LONG, "a", None), (3, LONG, "a", None), (None, LONG, "a", None), (None, LONG, None, None),
    (4, None, "a", None), (5, "", None, None), (6, " \t\x0b ", "b", None), (7, "UP and # " * 40, "a", None), (8, "same " * 80, "", None),
    (9, "é" * 20 + "A", "b", None), (10, " ".join(["x"] * 60), "b", None), (11, LONG + " $", "a", None), (12, LONG + " $", "c", None), (13, "a|b", "c", None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, None), (7, 0, 1), (9, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_every_order_by_brute_force(spark):
    docs, labels = spark.createDataFrame(TABLE, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = plain(filter_audit.audit(docs, labels))
    assert len(found) == 4 * 600
    assert found == brute(TABLE, LABELS)
    assert plain(filter_audit.audit(docs.repartition(7), labels.repartition(3))) == found


def test_one_text_holds_half_of_the_rows(spark):
    table = [(k, "copy " * 60 if k % 2 else f"{k} {LONG}", f"s{k % 3}", None) for k in range(300)] + [(5, "copy " * 60, "s9", None)]
    found = plain(filter_audit.audit(spark.createDataFrame(table, DOCS).repartition(8), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found == brute(table, [])


def test_long_texts_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = [(2, "word " * 400_000, "a", None), (1, "word " * 400_000, "a", None), (3, "A" * 1_000_000, "a", None)]
    assert plain(filter_audit.audit(spark.createDataFrame(table, DOCS), labels))["a", "EABCD", 1][:2] == (2, 1)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).collect() == []


def test_other_filters_and_measures(spark):
    rows = spark.range(64).select("id", F.col("id").alias("mask"), F.lit("p").alias("n"))
    masks = filter_audit.masks_of(rows, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0, "z": F.col("id") > 50}, F.col("id") % 4, {"odd": F.col("id") % 2 == 1})
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.order_steps(masks, "xyz", {"odd": "odd_lost"}).collect()}
    assert len(found) == 4 * 6 * 3
    own = [k for k in range(64) if k % 4 == 1]
    gone = [k for k in own if k > 50 and k % 3]
    r = found["1", "yzx", 2]
    assert (r.kept, r.removed, r.odd_lost) == (len([k for k in own if k % 3 and k <= 50]), len(gone), len(gone))
    assert r.redundant == len([k for k in own if k > 50 and k % 3 == 0])
    with pytest.raises(ValueError):
        filter_audit.order_steps(masks, "xxz", {})
