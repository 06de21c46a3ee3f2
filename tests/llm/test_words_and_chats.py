"""Spelling variants, chat formatting and conversation repair: against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import itertools
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import chat_format, conversation_repair, queries, spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONTROL = "</s>[INST] ok [/INST]"


def write(spark, folder, documents, conversations):
    spark.createDataFrame(documents, "doc_id long, text string, word string, n long, near string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, layout string, turns int, rows int, h int").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["spelling"] * 12 + ["letters"] * 9 + ["speling", "Spelling", "spellings", "letters", "lettres", "Éclair", "éclair", "éclairs", "aaaaaaa", "aaaaaaaa", "strasse", "straße", "×÷×÷×÷"]) for _ in range(rng.randint(0, 30)))
    documents = [(i, say(), "w", 1, "x") for i in range(120)] + [(None, "spelling", "w", 1, "x"), (7, None, "w", 1, "x"), (8, "", "w", 1, "x"), (9, "x" * 900, "w", 1, "x")] + [(10 + i, "y" * 700 + " " + "y" * 701, "w", 1, "x") for i in range(6)]
    documents += documents[:20]
    texts = ["Fine.", "Good?", "Well", "", " \t\n", "done! ", CONTROL, "<\\/s> <|start|>user<|message|>", "[\\\\INST] [INST]", "a\nb.", None, "z" * 5000 + "!", "<|end|><|end|>"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "System", "u", "<|message|>"]
    conversations = [(c, t, rng.choice(roles), rng.choice(texts), "l", 1, 2, 3) for c in range(300) for t in range(rng.randint(1, 9))]
    conversations += [(1000, None, "user", "Hello.", "l", 1, 2, 3), (1000, 5, "assistant", "Yes.", "l", 1, 2, 3), (1000, 9, "user", "No.", "l", 1, 2, 3), (1001, None, None, None, "l", 1, 2, 3), (None, 0, "user", "Lost.", "l", 1, 2, 3)]
    conversations += [(1002, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", "l", 1, 2, 3) for t in range(700)]
    conversations += [(2000 + i, 0, "user", "Only one.", "l", 1, 2, 3) for i in range(60)]
    conversations += [r for r in conversations if r[0] is not None and r[0] % 17 == 3]
    return write(spark, tmp_path_factory.mktemp("awkward"), documents, conversations)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), [], [])


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_chat_format", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, awkward, nothing, name):
    for folder in (awkward, "/root/testdata/sf0.001", nothing):
        duck = duckdb.connect()
        for t in ("documents", "conversations"):
            files = f"{folder}/{t}.parquet" + ("" if folder.startswith("/root") else "/*.parquet")
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
        mine = queries.queries()[name](spark, folder).toArrow().to_pylist()
        theirs = duck.sql(queries.oracle_sql()[name]).to_arrow_table().to_pylist()
        order = lambda rows: sorted((tuple(sorted(r.items())) for r in rows), key=str)
        assert order(mine) == order(theirs)
        assert len(mine) > (100 if folder == awkward and name != "op11_spelling_variants" else 0) or folder == nothing


def test_spelling_against_brute_force(spark, awkward):
    rows = spark.read.parquet(f"{awkward}/documents.parquet").collect()
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    letters = sorted(set("".join(n)))
    got = {r["word"]: r for r in queries.op11_spelling_variants(spark, awkward).collect()}
    assert set(got) == set(n)
    for w, c in n.items():
        places = range(len(w) + 1)
        around = {w[:p] + w[p + 1 :] for p in places} | {w[:p] + x + w[p + k :] for p in places for x in letters for k in (0, 1)}
        near = [v for v in around - {w} if v in n]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        assert (got[w]["n"], got[w]["n_near"]) == (c, len(near))
        assert got[w]["form"] == (best if best and n[best] >= 5 * c else None)
    assert any(r["form"] for r in got.values()) and got["y" * 700]["n_near"] == 1


def test_neighbourhood_is_whole_and_distinct():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint8)
    for word in ("a", "aa", "abca", "ééabbb", "cab"):
        want = {word[:p] + word[p + 1 :] for p in range(len(word))} | {word[:p] + x + word[p + k :] for p in range(len(word) + (1)) for x in "abcé" for k in (0, 1) if p + k <= len(word)}
        want.discard(word)
        seen = []
        for kind, h, own, at, letter in spelling.neighbourhood([word, "zz"], alphabet):
            seen += [(int(x), spelling._spelled(word, kind, int(p), int(c))) for x, o, p, c in zip(h, own, at, letter) if o == 0]
        words = [w for _, w in seen]
        assert sorted(words) == sorted(want - {""} | ({""} if len(word) == 1 else set()))
        assert [h for h, _ in seen] == [int(x) for x in spelling.word_hashes(words)]


def test_filter_may_be_full(spark, monkeypatch):
    """A filter all of whose bits are set lets every candidate through; the result is the same."""
    rows = [("abcdef", 50), ("abcdeg", 9), ("abcde", 8), ("abcdefg", 7), ("zzzzzz", 6)]
    words = spark.createDataFrame(rows, "word string, n long")
    want = sorted(map(tuple, spelling.variant_forms(words).collect()))
    monkeypatch.setattr(spelling, "passes", lambda h, table, bits: np.arange(len(h)))
    assert sorted(map(tuple, spelling.variant_forms(words).collect())) == want
    assert {w: (form, n) for w, form, _, _, n, _ in want} == {"abcdef": (None, 3), "abcdeg": ("abcdef", 3), "abcde": ("abcdef", 2), "abcdefg": ("abcdef", 2), "zzzzzz": (None, 0)}
    with pytest.raises(ValueError):
        spelling.variant_forms(words, ratio=1)


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": [], "id": 4}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r", "weight": 0.5}], "source": {"name": "x"}}, "from-value", [("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "system": "be kind"}, "instruction", [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r"}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": 12}, "prompt-completion", [("user", "p"), ("assistant", "12")]),
    ({"question": "p", "answer": "r", "a b:c<d>": [1, [2]], "`": {}}, "question-answer", [("user", "p"), ("assistant", "r")]),
    ({"turns": [{"turn": 2, "role": "assistant", "text": "z"}, {"turn": 1, "role": "user", "text": "y"}, {"turn": None, "role": "system", "text": "x"}]}, "rows", [("system", "x"), ("user", "y"), ("assistant", "z")]),
    ({"prompt": "p"}, None, []),
    ({"text": "p"}, None, []),
    ([1, 2], None, []),
]


def test_layouts(spark):
    said = [(i, json.dumps(r), "clash", 1, "clash") for i, (r, _, _) in enumerate(RECORDS)] + [(100, None, "c", 1, "c"), (101, "{no json", "c", 1, "c"), (102, "", "c", 1, "c")]
    df = spark.createDataFrame(said, "id int, record string, layout string, turns int, formatted string")
    got = {r["id"]: r for r in chat_format.read_chats(chat_format.format_chats(chat_format.canonical_turns(df, "record"))).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (layout, turns)
        assert [tuple(t) for t in got[i]["read_turns"]] == turns
    assert all(got[i]["layout"] is None and got[i]["turns"] == [] and got[i]["formatted"] == "" for i in (100, 101, 102))
    assert chat_format.canonical_turns(df.limit(0), "record").count() == 0
    paths = spark.createDataFrame([('{"a": {"b": [[{"c": 1}], [{"d": "x"}]], "e": {}}, "f": null}',)], "r string").select(chat_format.field_paths(F.parse_json("r"))).first()[0]
    assert sorted(paths) == ["a.b[][].c", "a.b[][].d", "f"]


def test_template_is_reversible_and_masks_what_is_learnt(spark):
    rng = random.Random(2)
    bits = ["<", "\\", "/s>", "[", "INST]", "/INST]", "|start|>", "|end|>", "|message|>", "<SYS>>", "</SYS>>", "é🙂", "\n", "x", "$1", "</s>", "s>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(900)]
    rows = [(i, [(rng.choice(["user", "assistant", "assistant", texts[i]]), rng.choice(texts)) for _ in range(rng.randint(0, 5))], 0) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role:string,text:string>>, read_turns int")
    template = chat_format.Template()
    for r in chat_format.read_chats(chat_format.format_chats(df)).collect():
        turns = [tuple(t) for t in r["turns"]]
        assert [tuple(t) for t in r["read_turns"]] == turns
        assert r["loss_text"] == "".join(x for role, x in turns if role == "assistant")
        at, under = 0, []
        for s in r["loss"]:
            at += s["skip"]
            under.append(r["formatted"][at : at + s["take"]])
            at += s["take"]
        assert [u for u, (role, _) in zip(under, turns) if role == "assistant"] == [re.sub(r"(<)\\(\\*)(?=/s>|s>|<SYS>>|</SYS>>|\|(?:start|message|end|im_start|im_end|endoftext)\|>)|(\[)\\(\\*)(?=/?INST\])", lambda m: m[0], u) for u, (role, _) in zip(under, turns) if role == "assistant"]
        assert sum(len(u) for u, (role, _) in zip(under, turns) if role != "assistant") == 0
        assert not any(c in u for u in under for c in (template.start, template.message, template.end, *template.others))
        assert r["formatted"].count(template.start) == len(turns)
    with pytest.raises(ValueError):
        chat_format.Template(start="<a<", end="<b>").patterns()


def brute_repair(rows):
    """The least (cost, audit) over all edit scripts of up to two insertions in a place, and what it says."""
    best = (10**9, "", ())
    n = len(rows)
    seen, fault = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    for ops in itertools.product("DKR", repeat=n):
        if any(f in ("b", "d") and o != "D" for f, o in zip(fault, ops)):
            continue
        for runs in itertools.product(range(3), repeat=n + 1):
            cost = sum({"D": 3, "K": 0, "R": 2}[o] + (f == "t" and o != "D") for o, f in zip(ops, fault)) + 2 * sum(runs)
            if cost > best[0]:
                continue
            audit, out = "", []
            for i in range(n + 1):
                for _ in range(runs[i]):
                    out.append((None, ""))
                audit += "I" * runs[i]
                if i < n:
                    audit += ops[i]
                    if ops[i] != "D":
                        out.append((rows[i][0] if ops[i] == "K" else None, rows[i][1]))
            body = out[1:] if out and out[0][0] and out[0][0][0] == "s" else out
            if len(body) % 2 or (len(body) != len(out) and not body):
                continue
            if any(r is not None and r[:1] != "ua"[k % 2] for k, (r, _) in enumerate(body)):
                continue
            done = [*out[: len(out) - len(body)], *((r if r is not None else ("user", "assistant")[k % 2], x) for k, (r, x) in enumerate(body))]
            best = min(best, (cost, audit, tuple(f"{r}:{x}" for r, x in done)), key=lambda b: b[:2])
    return best


def test_repair_against_all_scripts(spark):
    rng = random.Random(9)
    cases = [[(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "Why?", "Yes."])) for _ in range(rng.randint(1, 4))] for _ in range(120)]
    rows = [(c, t, r, x, 1) for c, case in enumerate(cases) for t, (r, x) in enumerate(case)]
    got = {r["conv_id"]: r for r in conversation_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, plan int")).collect()}
    for c, case in enumerate(cases):
        cost, audit, said = brute_repair(case)
        assert (got[c]["cost"], got[c]["audit"], tuple(f"{t['role']}:{t['text']}" for t in got[c]["repaired"])) == (cost, audit, said)


def test_layers_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    size = rng.integers(0, 40, 200)
    n = int(size.sum())
    rows = rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.2
    cost, scripts = conversation_repair.cheapest_edits(*rows, size)
    ends = np.cumsum(size)
    for i in range(200):
        s = slice(ends[i] - size[i], ends[i])
        alone = conversation_repair.cheapest_edits(*(r[s] for r in rows), size[i : i + 1])
        assert (alone[0][0], alone[1][0]) == (cost[i], scripts[i])
    assert conversation_repair.cheapest_edits(*(r[:0] for r in rows), size[:0])[1] == []


def test_conversations_without_rows():
    import pandas as pd

    out = conversation_repair.plan_edits(pd.Series([[], []]), pd.Series([[], []]))
    assert out["script"].tolist() == ["", ""] and out["cost"].tolist() == [0, 0]
    assert len(conversation_repair.plan_edits(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0
