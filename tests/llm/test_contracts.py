"""The corpus operators against brute-force versions, on a table with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import exact_dedup, language_id, line_dedup, ngram_join, pii, quality, sentencepiece_lattice, token_counts, token_files
from loomstat.llm.common import lower_ascii
from loomstat.llm.queries import vocabulary
from loomstat.llm.textbytes import mix

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, line string, h string, id long, node long, salt int"


def texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "an", "er", "ou", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out: list[str | None] = [None, "", " ", "\n\n", "12 34", "!!", "a b", "A B", "a  b\t", "One two three four", "one two three four"]
    base = say(80)
    out += [base, base, base.upper(), base.replace(" ", "\n"), " " + base + " "]
    for cut in (1, 3, 6, 9, 14, 25):  # near copies of one text
        w = base.split()
        out += [" ".join([*w[:-cut], *say(cut).split()]), " ".join([*say(cut).split(), *w[cut:]])]
    shared = say(60)
    out += [f"{say(40)}\nCommon Line \n{shared}\n{say(30)}" for _ in range(12)]
    out += ["common line", say(6000), "x" * 5000, "y z " * 3000, "mail a.b+c@d-e.example.org, +1 (555) 010-9999 or 10.0.0.255 card 4111 1111 1111 1111.", "no 1.2.3.999 card 4111111111111112 +12", "🙂 ▁ <|endoftext|> \x85 　 tail", "l'été dernier"]
    out += [say(rng.randint(1, 120)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 3, t, ["en", "fr", None][i % 3], f"s{i % 2}", None, 1, "x", "y", 5, 6, 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).cache(), {i * 3: t or "" for i, t in enumerate(texts())}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_line_dedup(table, empty):
    df, docs = table
    keys = Counter(k for t in docs.values() for k in {x.strip(WHITE).translate(FOLD) for x in t.split("\n")})
    got = collected(line_dedup.drop_repeated_lines(df))
    assert set(got) == set(docs)
    for i, t in docs.items():
        left = [x for x in t.split("\n") if not x.strip(WHITE) or keys[x.strip(WHITE).translate(FOLD)] < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (t.count("\n") + 1, t.count("\n") + 1 - len(left), "\n".join(left))
    assert sum(r["n_dropped"] for r in got.values()) >= 12
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    again = line_dedup.drop_repeated_lines(df.unionByName(df)).collect()  # rows of one id are one document
    assert sorted(map(tuple, again)) == sorted(2 * [tuple(r) for r in got.values()])
    ten = df.sparkSession.createDataFrame([(5, "one line")] * 12 + [(None, "one line")] * 12 + [(i, "one line\nother") for i in range(6, 6 + 7)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.drop_repeated_lines(ten).collect()} == {0}
    more = ten.unionByName(df.sparkSession.createDataFrame([(50, " ONE line")], "doc_id long, text string"))
    assert {r["n_dropped"] for r in line_dedup.drop_repeated_lines(more).collect()} == {1}


def test_only_ascii_capitals_are_folded(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, c + "Ab") for c in chars], "c string, x string")
    bad = df.where(lower_ascii(F.col("x")) != F.concat(F.when(F.col("c").between("A", "Z"), F.lower("c")).otherwise(F.col("c")), F.lit("ab")))
    assert bad.count() == 0


def test_exact_dedup(table, empty):
    df, docs = table
    groups: dict[str, list] = {}
    for i, t in docs.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    got = collected(exact_dedup.duplicate_groups(df))
    for c, members in groups.items():
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(c.encode()).hexdigest())
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty).count() == 0
    twice = exact_dedup.duplicate_groups(df.unionByName(df)).collect()
    assert all(r["group_size"] == 2 * got[r["doc_id"]]["group_size"] and r["keep_id"] == got[r["doc_id"]]["keep_id"] for r in twice)


def brute_components(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in docs}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in docs:
        for j in docs:
            both = len(sets[i] & sets[j])
            if j < i and sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in docs}


@pytest.mark.parametrize("block", [1024, 2])
def test_ngram_join(table, empty, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df, docs = table
    n, comp = brute_components(docs)
    got = collected(ngram_join.linked_groups(df))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (n[i], comp[i]) for i in docs}
    assert len(set(comp.values())) < len(docs) - 10
    if block == 1024:
        kept = ngram_join.one_of_each_group(df)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(comp.values())
        assert ngram_join.linked_groups(empty).count() == 0


def test_segments_keep_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 11, 17, 47, 64, 95, 96, 130, 400):
        for _ in range(60):
            a = np.unique(mix(rng.integers(0, 2**63, n, dtype=np.uint64)))
            d = int(len(a) * 0.25)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - rng.integers(0, d + 1)]], mix(rng.integers(0, 2**63, rng.integers(0, d + 1), dtype=np.uint64))]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
                continue
            sent = [{(int(c), role) for role, got in ngram_join.segments(x) for c in got} for x in (a, b)]
            # a node drops 9 % of its size of a role's segments: so many and one more are shared in some pair of roles
            most = max(len({c for c, r in sent[0] if r == p} & {c for c, r in sent[1] if r == q}) for p in range(3) for q in range(3))
            assert most > 9 * max(len(a), len(b)) // 100
    a = np.arange(1, 21, dtype=np.uint64)  # all in one segment: single shingles are sent as well
    sent = [dict(ngram_join.segments(x)) for x in (a, a[:18])]
    assert all(2 in s for s in sent) and len(np.intersect1d(sent[0][2], sent[1][2])) > 1


def test_personal_data(table, empty):
    df, docs = table
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"[\x20-]", "", m)) <= 19 and pii.luhn(re.sub(r"[\x20-]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    }
    got = collected(pii.find_personal_data(df))
    for i, t in docs.items():
        want = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in patterns.items() for m in re.finditer(p, t) if ok(m.group())]
        assert got[i]["base"] == ",".join(want)
    assert sum(r["n_card"] for r in got.values()) == 1
    assert pii.find_personal_data(empty).count() == 0
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", "b.c", "1.2", ".", "255", "256", "+1", " ", "-", "4111111111111111", "(", "x@y.z"]) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == [[m.span() for m in re.finditer(p, t) if ok(m.group())] for p, ok in patterns.values()]


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"please write to u{i}@mail.example.org today") for i in range(30)] + [(100, "please write to user#4711x today"), (101, "room to 4711 gone")]
    # a right pattern alone, the start of a text, a short token, and a second generation: seeds teach "call desk", its
    # finds teach "reach me", which no seed has met
    rows += [(200 + i, f"call desk +1 555 010 {1000 + i} now") for i in range(8)] + [(300 + i, f"call desk x{i}7 now") for i in range(2)]
    rows += [(400, "7# now"), (401, "nothing 77 here")]
    df = spark.createDataFrame([(*r, 1, "r", "p") for r in rows], "doc_id long, text string, left int, rank string, pattern string")
    got = collected(pii.find_personal_data(df))
    at = rows[30][1].index("user#")
    assert got[100]["discovered"] == got[100]["spans"] == f"email:{at}:{at + len('user#4711x')}" and got[101]["discovered"] == got[401]["discovered"] == ""
    assert all(got[i]["spans"] == got[i]["base"] != "" for i in range(30))
    assert {got[i]["discovered"].split(":")[0] for i in (300, 301)} == {"phone"}
    assert [c["token"] for c in pii.candidates("a 7", [[], [], [], []])] and pii.candidates("", [[], [], [], []]) == []


def test_discovered_instances_teach_new_patterns(spark):
    rows = [(i, f"code for u{i}@x.org end") for i in range(10)] + [(20 + i, f"code for k{i}7 end") for i in range(6)]
    rows += [(40 + i, f"badge is k{i}7 or") for i in range(6)] + [(60, "badge is zz99 or"), (61, "badge was zz99 and")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once, thrice = (collected(pii.find_personal_data(df, rounds=r, least_score=0.6)) for r in (1, 3))
    assert once[20]["discovered"] and not once[60]["discovered"]
    assert thrice[60]["discovered"] == "email:9:13" and not thrice[61]["discovered"]


def test_token_counts_and_files(table, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    df, docs = table
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    for chunk, overlap in ((32_768, 256), (200, 2)):
        got = collected(token_counts.count_tokens(df, path, chunk_chars=chunk, overlap_chars=overlap))
        assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in got.items()} == {i: (len(docs[i].encode()), len(want[i])) for i in docs}
    assert token_counts.count_tokens(empty, path).count() == 0
    assert token_counts.count_tokens(df.unionByName(df), path, chunk_chars=200).count() == 2 * len(docs)
    token_files.write_token_files(df, path, str(tmp_path / "f"), shard_ids=3000)
    got, at = collected(token_files.read_token_files(df.sparkSession, str(tmp_path / "f"))), 0
    for i in sorted(docs):
        ids = [*want[i], 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_files.write_token_files(empty, path, str(tmp_path / "none"))
    assert token_files.read_token_files(df.sparkSession, str(tmp_path / "none")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (5, 3), (100, 10**9), (1000, 1000), (20_000, 40), (20_000, 10**12)):
        v = np.sort(rng.integers(0, top + 1, n))
        for values in (v, np.where(v < top // 2, 0, top)):  # the second leaves stretches without a one
            code = token_files.ef_encode(values, top)
            assert len(code[2]) <= 4 + len(code[1]) // 64
            assert (token_files.ef_select(*code, n, top, np.arange(n)) == values).all()
            for i in {0, n // 2, n - 1}:
                assert token_files.ef_select(*code, n, top, np.array([i])) == values[i]
            mixed = rng.permutation(n)[:50]
            assert (token_files.ef_select(*code, n, top, mixed) == values[mixed]).all()
    assert not len(token_files.ef_select(*token_files.ef_encode(np.zeros(0, np.int64), 0), 0, 0, np.zeros(0)))


def test_sentencepiece(table, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    df, docs = table
    pieces = sentencepiece_lattice.load_pieces(path)
    got = collected(sentencepiece_lattice.encode_pieces(df, pieces))
    assert {i: r["piece_ids"] for i, r in got.items()} == {i: lib.encode(t) for i, t in docs.items()}
    assert all(r["round_trip"] for r in got.values())
    none = collected(sentencepiece_lattice.encode_pieces(df, pieces, dictionary_units=0))  # all folded in tasks
    assert {i: r["piece_ids"] for i, r in none.items()} == {i: r["piece_ids"] for i, r in got.items()}
    kept = sentencepiece_lattice.with_pieces(df.withColumn("n_pieces", F.lit("x")).withColumn("unit", F.lit(1)), pieces)
    assert kept.columns == [*df.columns, "unit", *sentencepiece_lattice.MADE] and kept.where("round_trip").count() == len(docs)
    assert sentencepiece_lattice.encode_pieces(empty, pieces).count() == 0


def test_lattice_folds_as_the_library_merges(spark):
    """Every kind of unit through the Spark joins: words, indents, texts without spaces, emoji, rare characters."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    table = sentencepiece_lattice.load_pieces(path)
    rng = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkqjxz" * 3 + "ETAéüß中文字日本🙂0123456789.,-()"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    words += [p.strip() for p in table.pieces[300:] if p.strip()][::9]
    words += ["token", "tokenization", "international", "aaaa", "aaaaaaaaaaaaa", "the" * 9, "日本語中文字" * 4]
    units = [" " * rng.choice([1, 1, 1, 2, 3, 5, 8, 17]) + w for w in words] + words
    units = sorted({u for u in units if len(u) <= sentencepiece_lattice.LONGEST and " " not in u.lstrip(" ") and "\n" not in u})
    rows = sentencepiece_lattice.folded(sentencepiece_lattice.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), table), table).collect()
    want = {u: lib.encode(u[1:]) if u[0] == " " else lib.encode("\n" + u)[2:] for u in units}
    assert {r["unit"]: r["ids"] for r in rows} == want
    texts = ["  def f(x):\n        return x\n\n\tif y:  z   \n", "日本語の文章には空白がない。" * 400, "x" * 3000, "ab" * 900 + " " + "thequickbrownfox" * 90, "▁▁lit▁eral ▁", "\n\n", " ", *(" ".join(rng.choice(units) for _ in range(60)) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (300_000, 0):
        got = collected(sentencepiece_lattice.encode_pieces(df, table, dictionary_units=most))
        assert {i: r["piece_ids"] for i, r in got.items()} == {i: lib.encode(t) for i, t in enumerate(texts)}
        assert all(r["round_trip"] for r in got.values())


def test_language_id(spark, empty):
    rng = random.Random(0)
    say = {"en": ["the", "and", "thing", "ation", "with"], "de": ["der", "und", "schung", "keit", "mit"], "fr": ["le", "et", "eaux", "tion", "avec"], "es": ["el", "y", "ción", "mente", "con"]}
    rows = [(i, " ".join(rng.choice(say[lang]) for _ in range(20)), lang) for i, lang in enumerate(list(say) * 40)] + [(900, None, "en"), (901, "12 !?", None), (902, "中文", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df, F.col("doc_id") % 5 < 4, per_language=25)
    got = collected(language_id.identify(df, model))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:160]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] != "und"
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and {900, 901}.isdisjoint(r["doc_id"] for r in kept.collect())
    many = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopq'[i % 7] * 3} {i % 70}", f"x{i % 70:02}") for i in range(700)], "doc_id long, text string, lang string")
    all_of = language_id.fit_language_model(many.unionByName(many), F.lit(True), per_language=5)
    assert sum(map(len, all_of.members.values())) == 70
    assert language_id.families({"en": np.eye(3)[0], "qa": np.array([0.0, 1, 0.1]), "qb": np.array([0.0, 1, 0.2]), "qc": np.array([1.0, 0.1, 0]), "qd": np.eye(3)[2]}) == {"en": "germanic", "qa": "like qa", "qb": "like qa", "qc": "germanic", "qd": "like qd"}
    none = language_id.fit_language_model(empty, F.lit(True))
    assert {r["doc_id"] for r in language_id.keep_identified(df, none).collect()} == {r[0] for r in rows} - {900, 901}
    assert language_id.identify(empty, none).count() == 0 and {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}


def test_quality(spark, table, empty):
    df, docs = table
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["the", "plain", "words", "here."]) + ("***" if i % 2 else "") for _ in range(30))) for i in range(200)] + [(900, None), (901, "")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(corpus)
    got = collected(quality.score_quality(stats, quality.fit_quality(stats, labels, F.col("doc_id") % 3 != 1)))
    assert all(got[i]["predicted"] == 1 - i % 2 for i in range(200)) and all(0 <= r["score"] <= 1 for r in got.values())
    blank = quality.fit_quality(stats, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(stats, blank).collect()} == {0.5}
    none = quality.document_statistics(empty)
    assert quality.score_quality(none, quality.fit_quality(none, labels, F.lit(True))).count() == 0
    assert list(quality.isotonic(np.arange(4), np.array([1.0, 0.0, 2.0, 3.0]), np.ones(4))) == [0.5, 0.5, 2.0, 3.0]
