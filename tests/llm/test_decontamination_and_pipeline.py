from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

from loomstat.llm import decontamination as op

ITEM = "A train leaves Berlin at 9 with 120 passengers and arrives in Hamburg after 3 hours, so how fast did it go on average?"


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    other = ITEM.replace("Berlin", "Paris").replace("Hamburg", "Lyon").replace("120", "77").replace("3 hours", "5 hours")
    rows = [(1, "Some words. " + ITEM + " More words."), (2, other), (3, ITEM.upper()), (4, "A train leaves. Nothing else of it is here."), (5, None), (6, ""), (7, "short one"), (1, "Some words. " + ITEM + " More words."), (8, " ".join(ITEM.split()[:9]))]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, words string, h string")
    got = {(r["doc_id"], r["item_id"]) for r in op.leaks(docs, bench).collect()}
    assert {(1, 1), (2, 1), (7, 2)} <= got and not {4, 5, 6, 8} & {d for d, _ in got}
    kept = op.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 8}
    assert op.leaks(docs.limit(0), bench).count() == 0 and op.leaks(docs, bench.limit(0)).count() == 0


def test_large_benchmarks_are_joined_by_a_shuffle(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of it at all is here")], "doc_id long, text string")
    small = op.leaks(docs, bench).collect()
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", 0)
    assert op.leaks(docs, bench).collect() == small and len(small) == 1


def test_inconsistent_slots_are_no_leak(spark):
    bench = spark.createDataFrame([(1, "give 5 then 5 then 5 then 5 then 5 then 5 then 5 then 5 to them")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "give 1 then 2 then 3 then 4 then 6 then 7 then 8 then 9 to them"), (2, "give 4 then 4 then 4 then 4 then 4 then 4 then 4 then 4 to them")], "doc_id long, text string")
    assert [r["doc_id"] for r in op.leaks(docs, bench).collect()] == [2]


def test_an_occurrence_counts_by_itself(spark):
    variant = ITEM.replace("120", "77").replace("at 9", "at 4").replace("3 hours", "5 hours").replace("Berlin", "Paris").replace("Hamburg", "Lyon")
    another = ITEM.replace("120", "15").replace("at 9", "at 6").replace("3 hours", "8 hours").replace("Berlin", "Rome").replace("Hamburg", "Turin")
    longer = variant.replace("with 77", "with all of its 77")
    series = "The first numbers of a row are 2, 4, 6, 8, 10, 12, 14, 16, 18, 20 and so on, which one follows?"
    series_again = series.replace("2, 4, 6, 8, 10, 12, 14, 16, 18, 20", "3, 6, 9, 12, 15, 18, 21, 24, 27, 30")
    numbers = "1, 5, 7, 8, 11, 13, 17, 19, 23, 29"
    bench = spark.createDataFrame([(1, ITEM), (2, variant), (3, series), (4, numbers)], "item_id long, text string")
    rows = [(1, ITEM + " And now: " + variant), (2, another + " Or else. " + longer), (3, series), (4, series_again), (5, "We saw 9, 2, 7, 1, 4, 8, 3, 6, 5, 0 on the board."), (6, numbers)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op.leaks(docs, bench).collect()}
    assert {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 3), (6, 4)} <= got
    assert not {d for d, i in got} & {5} and (1, 3) not in got


def test_names_of_several_words_and_at_the_start(spark):
    two = "Mary Smith drives from Los Angeles to San Diego with 4 boxes, then Mary Smith flies to New York by night, so how far is it in all for the boxes?"
    other = two.replace("Mary Smith", "John Allan Miller").replace("Los Angeles", "Paris").replace("San Diego", "Le Havre").replace("New York", "Santa Cruz").replace("4", "6")
    start = "Tom has 5 apples. Mary has 7 pears. Peter eats 2 of them. How many of them are left on the table?"
    start_again = start.replace("Tom", "Jane").replace("Mary", "Ben").replace("Peter", "Ruth").replace("5", "8").replace("7", "9").replace("2", "3")
    bench = spark.createDataFrame([(1, two), (2, start)], "item_id long, text string")
    rows = [(1, two), (2, other), (3, start), (4, start_again), (5, start.lower()), (6, two.upper()), (7, "Heard again: " + start_again + " Nobody knows."), (8, "Tom has a table and Mary Smith has a box.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 1), (7, 2)}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    from .test_contracts import WHITE, brute_components

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {i: t for i, t in docs.items() if any(map(str.isalpha, t))}
    groups: dict[str, list] = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    _, comp = brute_components(left)
    left = {i: left[i] for i in set(comp.values())}
    flat = lambda t: re.sub(r"[^\w\s]", "", t.lower()).split()
    items = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (flat(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())]
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, flat(t)) for i, t in left.items())}
    left = {i: t for i, t in left.items() if not any(len(g & grams[i]) >= 0.75 * len(g) for g in items if g)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(left) and all(r["round_trip"] and r["text"] == docs[r["doc_id"]] for r in got)
    assert WHITE


def test_the_rest_works_without_this_package(tmp_path):
    root = Path(__file__).parent.parent.parent
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules['loomstat.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
