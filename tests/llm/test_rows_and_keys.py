"""Rows that repeat an id, rows without one, keys that must not be taken for each other, large groups of near copies."""

from __future__ import annotations

import random

import numpy as np

from loomstat.llm import exact_dedup, ngram_join, token_counts, token_files
from loomstat.llm.queries import vocabulary
from loomstat.llm.textbytes import span_hashes

from .test_contracts import brute_components


def say(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def thue_morse(n: int) -> tuple[str, str]:
    one = ["ab"[bin(i).count("1") % 2] for i in range(n)]
    return "".join(one), "".join("ba"["ab".index(c)] for c in one)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Pairs on both sides of the bound, chains, blocks far smaller than the group; rows handed on stay in proportion."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(0)
    base, texts = say(rng, 90).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{i}x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for _ in range(20):  # chains that drift away
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = say(rng, 1)
            w.append(say(rng, 1))
            texts.append(" ".join(w))
    docs = dict(enumerate(texts))
    n, comp = brute_components(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ngram_join.linked_groups(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (n[i], comp[i]) for i in docs}
    assert 1 < len(set(comp.values())) < len(docs)


def test_blocks_hand_on_a_forest():
    """A block of m nodes that all are linked gives m - 1 rows."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(200)[:190]], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(100)]
    rows = {"cell": [7] * 100, "i": [0] * 100, "j": [0] * 100, "side": [0] * 100, "node": list(range(100)), "n": [len(s) for s in sets], "comp": list(range(100)), "sketch": [ngram_join.bit_sketch(s) for s in sets], "grams": [s.tobytes() for s in sets]}
    kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))
    found = list(ngram_join._in_blocks(ngram_join._forest)(iter([batch.slice(0, 60), batch.slice(60)])))
    assert sum(b.num_rows for b in found) == 99


def test_sets_that_share_one_sum_are_told_apart():
    hashes, cuts = np.array([1, 2, 3, 4, 5], np.uint64), np.array([0, 2, 2, 5])
    one, two = ngram_join.names_of(hashes, cuts)
    assert (ngram_join.nodes_of(hashes, cuts, np.zeros(0, np.int64)) == one).all() and one[1] == two[1] == 0
    assert (ngram_join.nodes_of(hashes, cuts, one[:1]) == [two[0] & ~3, one[1], one[2]]).all()


def test_repeated_and_missing_ids(spark):
    rng = random.Random(5)
    x, y, z = say(rng, 40), say(rng, 40), say(rng, 40)
    rows = [(1, x), (2, x), (2, y), (2, y), (3, z), (None, z), (None, y + " "), (None, say(rng, 9)), (None, None), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, 1, "r", "m") for i, t in rows], "doc_id long, text string, id int, row string, mark string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    # y with a space behind has more characters, so the row without an id stays
    exact = sorted(exact_dedup.drop_duplicates(df).collect(), key=key)
    assert [(r["doc_id"], r["text"] or "") for r in exact] == sorted([(1, x), (3, z), (4, ""), (None, rows[7][1]), (None, y + " ")], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    near = ngram_join.one_of_each_group(df)
    assert near.columns == df.columns
    # texts without words are linked with nothing: each such (id, text) stays once
    got = sorted(((r["doc_id"], r["text"] or "") for r in near.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == sorted([(1, x), (2, y), (3, z), (4, ""), (None, ""), (None, rows[7][1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_words_that_simple_hashes_confuse(spark, tmp_path):
    from tokenizers import Tokenizer

    a, b = thue_morse(4096)
    docs = {1: a, 2: b, 3: f"{a} {b}", 4: f"{b} {a}", 5: f"{a[:1024]} {b[:1024]} {a[:64]} {b[:64]}"}
    raw = np.frombuffer((a + b).encode(), np.uint8)
    for n in (1, 7, 8, 64, 500, 1024, 4096):
        one, two = (span_hashes(raw, np.array([0, 4096]), np.array([n, 4096 + n]), k) for k in (0, 1))
        assert one[0] != one[1] and two[0] != two[1] and one[0] != two[0]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    assert len({r["component_id"] for r in ngram_join.linked_groups(df).collect()}) == len(docs)
    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()} == want
    token_files.write_token_files(df, path, str(tmp_path / "f"))
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect()} == want


def test_leaks_of_rows_that_share_an_id(spark):
    from loomstat.llm import decontamination as op

    rng = random.Random(9)
    item = say(rng, 24)
    half, rest = " ".join(item.split()[:12]), " ".join(item.split()[12:])
    bench = spark.createDataFrame([(1, item), (1, say(rng, 20))], "item_id long, text string")
    rows = [(1, f"{half} {say(rng, 9)}"), (1, f"{say(rng, 9)} {rest}"), (2, f"so {item} then"), (2, say(rng, 30)), (None, item), (None, say(rng, 30)), (None, half), (None, rest)]
    df = spark.createDataFrame([(i, t, "r", 1, "b") for i, t in rows], "doc_id long, text string, row string, key int, bad string")
    assert {(r["doc_id"], r["item_id"]) for r in op.leaks(df, bench).collect()} == {(2, 1), (None, 1)}
    left = op.drop_leaks(df, bench)
    assert left.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {r for k, r in enumerate(rows) if k not in (2, 4)}
    assert op.drop_leaks(df.limit(0), bench).count() == 0


def test_slots_are_held_from_either_side(spark):
    from loomstat.llm import decontamination as op

    item = "the jar had 11 beans the cup had 22 beans the box had 33 beans the bag had 44 beans so which had most of all"
    same = item.replace("22", "11").replace("33", "11").replace("44", "11")
    other = item.replace("11", "61").replace("22", "72").replace("33", "83").replace("44", "94")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, other), (2, same)], "doc_id long, text string")
    assert {r["doc_id"] for r in op.leaks(df, bench).collect()} == {1}


def test_huge_text_without_and_with_spaces(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(2)
    words = [say(rng, 1) for _ in range(5000)]
    docs = {1: " ".join(rng.choice(words) for _ in range(400_000)), 2: "ab" * 40_000, 3: "é" * 33_000 + " x"}
    lib = Tokenizer.from_file(path)
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, path).collect()} == want


def test_only_rows_that_may_be_odd_are_joined(spark, monkeypatch, request):
    """Rows that a bit table does not let by stay without a shuffle, also where joins may not broadcast; a full table loses none."""
    from loomstat.llm import common, exact_dedup

    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(i, f"text {i // 2 if i < 400 else i}", i) for i in range(3000)] + [(None, "alone", 1), (None, "text 7", 2), (5000, "twice", 3), (5000, "twice", 4), (5000, "other", 5), (None, None, 6), (None, "", 7), (None, " ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int")
    want = {(i, t) for i, t, _ in rows if (i is not None and (i >= 400 or i % 2 == 0)) or t in ("alone", " ")}
    for bits in (common.ODD_BITS, 0):  # without bits a row the least table has to do
        monkeypatch.setattr(common, "ODD_BITS", bits)
        out = exact_dedup.drop_duplicates(df)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
    told = exact_dedup.duplicate_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in told.splitlines() if "Exchange" in line and "salt" in line and "content" in line]
