r"""Conversation structure repair: the cheapest edits that make roles follow (s?(ua)+)?, found by a rank-compressed program.

A conversation is worked through row by row. A macro edit is a run of insertions and what happens to the next row (delete,
keep, rerole); written as I...I and one more initial, no macro is the beginning of another, so macros sorted by their codes
compare as the audits that they spell. A state (nothing yet, after s, after u, after a) therefore needs no audit string: it
keeps its cost, the rank of its audit among the layer's states, and a pointer to the state and macro it came from. Audits are
read back along the pointers. The layers of all conversations of a batch advance together in numpy; the rows of texts stay in
Spark, which builds the repaired conversation from the edits.

Defined results: a null role or text is one space; rows are taken by turn (null first; ties by role, then text); repeated
rows are duplicates; texts of any length are handled whole, but a repaired conversation is one value and so ends at 2 GB; a
conversation without rows has an empty audit and text; an empty table gives an empty table; a null conversation id is a
conversation of its own; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import WHITE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Macro edits in the order of their codes; longer runs of insertions never pay.
MACROS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
ENDS = ("", "I", "II")
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Classes of a role's initial.
INITIALS = "sua"
#: Rows whose layers are advanced together; a longer conversation is a batch of its own.
ROWS = 1 << 18
_FAR = 1 << 40


def _role_after(state: int) -> str:
    """The role that an insertion or rerole must have in a state."""
    return "a" if state == AFTER_U else "u"


def _step(state: int, code: str, initial: int) -> int | None:
    """The state after one edit, None where it isn't allowed. initial: index in INITIALS, 3 for others."""
    if code == "D":
        return state
    role = _role_after(state) if code in "IR" else (INITIALS + "-")[initial]
    if role == "s":
        return AFTER_S if state == NONE else None
    if role != _role_after(state):
        return None
    return AFTER_U if role == "u" else AFTER_A


def _macro(state: int | None, macro: str, initial: int) -> int | None:
    for code in macro:
        state = None if state is None else _step(state, code, initial)
    return state


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target[initial, p, m] or -1, cost[deleted, truncated, m], target of ENDS[p, m], cost of ENDS)."""
    target = np.array([[[-1 if (q := _macro(p, m, i)) is None else q for m in MACROS] for p in range(4)] for i in range(4)])
    price = {"D": DELETE, "K": KEEP, "R": REROLE}
    cost = np.array([[[_FAR if gone and m[-1] != "D" else INSERT * (len(m) - 1) + price[m[-1]] + (TRUNCATED if cut and m[-1] != "D" else 0) for m in MACROS] for cut in (0, 1)] for gone in (0, 1)])
    return target, cost, np.array([[-1 if (q := _macro(p, m, 3)) is None else q for m in ENDS] for p in range(4)]), INSERT * np.arange(len(ENDS))


_TARGET, _COST, _END_TARGET, _END_COST = _tables()


def cheapest_edits(initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(cost, script) of conversations whose rows lie one after the other, size[i] rows the i-th. A script is a series of
    edits of two characters: the initial of the edit, then u or a (the role it gives), = (own role) or - (none)."""
    n = len(size)
    order = np.argsort(-size, kind="stable")
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[order]
    long = size[order]
    cost = np.full((n, 4), _FAR, np.int64)
    cost[:, NONE] = 0
    rank = np.tile(np.arange(4), (n, 1))
    back = []
    wide = len(MACROS)
    each = np.arange(4 * wide)
    for layer in range(int(long[0]) if n else 0):
        live = int(np.searchsorted(-long, -layer, "left"))  # those with more rows than that
        row = first[:live] + layer
        target = _TARGET[initial[row]].reshape(live, -1)
        paid = (cost[:live, :, None] + _COST[gone[row].astype(int), cut[row].astype(int)][:, None, :]).reshape(live, -1)
        # cost, then the order of audits: rank of the state before, then the macro's code
        key = paid * 64 + (rank[:live, :, None] * wide + np.arange(wide)).reshape(live, -1)
        best = np.stack([np.where(target == q, key, _FAR * 64).argmin(1) for q in range(4)], 1)
        reach = np.take_along_axis(target, best, 1) == np.arange(4)
        won = np.take_along_axis(key, best, 1)
        cost[:live] = np.where(reach, np.minimum(won // 64, _FAR), _FAR)
        audit = np.where(cost[:live] < _FAR, won % 64, 64)
        rank[:live] = audit.argsort(1, kind="stable").argsort(1, kind="stable")
        back.append(each[best].astype(np.int8))
    # the last run of insertions; a finished conversation is empty or ends with an assistant
    ended = np.isin(_END_TARGET, (NONE, AFTER_A))
    key = np.where(ended[None], (cost[:, :, None] + _END_COST) * 64 + rank[:, :, None] * len(ENDS) + np.arange(len(ENDS)), _FAR * 64).reshape(n, 4 * len(ENDS))
    at = key.argmin(1)
    total, scripts = np.zeros(n, np.int64), [""] * n
    for i in range(n):
        p, m = divmod(int(at[i]), len(ENDS))
        total[order[i]] = key[i, at[i]] // 64
        path = []
        state = p
        for layer in range(int(long[i]) - 1, -1, -1):
            before, macro = divmod(int(back[layer][i, state]), wide)
            path.append((before, MACROS[macro], int(initial[first[i] + layer])))
            state = before
        out = []
        for state, macro, kind in [*reversed(path), (p, ENDS[m], 3)]:
            for code in macro:
                out.append(code + {"D": "-", "K": "="}.get(code, _role_after(state)))
                state = _step(state, code, kind)
        scripts[order[i]] = "".join(out)
    return total, scripts


def _faults(owner: np.ndarray, blank: np.ndarray, key: np.ndarray, open_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(duplicate, truncated) of rows that aren't blank, the first fault counting. key: 16 bytes that stand for role and text."""
    _, first = np.unique(np.rec.fromarrays([owner, key[:, 0], key[:, 1]]), return_index=True)
    seen = np.ones(len(owner), bool)
    seen[first] = False
    twice = seen & ~blank
    return twice, open_end & ~blank & ~twice


def plan_edits(flags: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """flags: of each row, initial class + 4 if blank + 8 if its end is open; keys: two 64-bit halves of a row's digest."""
    size = flags.map(len).to_numpy(np.int64)
    out, a = [], 0
    while a < len(size):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(size[a:]), ROWS, "right")))
        out.append(_plan(size[a:b], flags.iloc[a:b], keys.iloc[a:b]))
        a = b
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "script")})


def _plan(size: np.ndarray, flags: pd.Series, keys: pd.Series) -> pd.DataFrame:
    n, owner = len(size), np.repeat(np.arange(len(size)), size)
    code = np.concatenate([np.zeros(0, np.int64), *flags]).astype(np.int64)
    key = np.concatenate([np.zeros(0, np.int64), *keys]).astype(np.int64).reshape(-1, 2)
    initial, blank, open_end = code & 3, code & 4 > 0, code & 8 > 0
    twice, cut = _faults(owner, blank, key, open_end)
    count = lambda on: np.bincount(owner, on, n).astype(np.int64)
    pair = 4 * initial[:-1] + initial[1:]
    wrong = np.zeros(len(code))
    wrong[1:] = (owner[1:] == owner[:-1]) & ~np.isin(pair, [4 * INITIALS.index(x) + INITIALS.index(y) for x, y in ("su", "ua", "au")])
    cost, scripts = cheapest_edits(initial, blank | twice, cut, size)
    return pd.DataFrame({"blank": count(blank), "duplicate": count(twice), "truncated": count(cut), "illegal": count(wrong), "cost": cost, "script": scripts})


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults planted by the crc32 of "<conv_id>:<turn>" modulo 20; nulls are one space there,
    and in roles and texts: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), h.cast("int").alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(1), copies).alias("copies")).select("conv_id", "turn", "role", "text", F.explode_outer("copies").alias("here"))


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", here_col: str | None = None) -> DataFrame:
    """Per conversation of rows (id_col, turn, role, text): id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    repaired is an array of (role, text). A row whose here_col is null only says that its conversation exists.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = said("role"), said("text")
    shown = F.rtrim(text, F.lit(WHITE))
    kind = F.coalesce(*[F.when(F.substring(role, 1, 1) == x, i) for i, x in enumerate(INITIALS)], F.lit(3))
    flag = kind + F.when(shown == "", 4).otherwise(0) + F.when(~F.substring(shown, -1, 1).isin(".", "!", "?"), 8).otherwise(0)
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), flag.alias("flag"), half(1).alias("k0"), half(17).alias("k1"))
    if here_col:
        row = F.when(F.col(here_col).isNotNull(), row)
    whole = rows.select(F.col(id_col), row.alias("row")).groupBy(id_col).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    keys = F.flatten(F.transform("rows", lambda r: F.array(r["k0"], r["k1"])))
    plan = pandas_udf(plan_edits, "blank long, duplicate long, truncated long, illegal long, cost long, script string")
    found = whole.select(id_col, "rows", gaps.alias("gaps"), plan(F.transform("rows", lambda r: r["flag"]), keys).alias("plan"))
    script = F.col("plan.script")

    def edit(r, e):
        made = F.when(e.startswith("K"), r["role"]).when(e.endswith("u"), "user").otherwise("assistant")
        return F.struct(made.alias("role"), F.when(e.startswith("I"), "").otherwise(r["text"]).alias("text"))

    def edits(r, macro):
        left = F.filter(F.regexp_extract_all(macro, F.lit("([DIKR].)"), F.lit(1)), lambda e: e != "D-")
        return F.transform(left, lambda e: edit(r, e))

    macros = F.regexp_extract_all(script, F.lit("((?:I.)*[DKR].)"), F.lit(1))
    none = F.struct(F.lit("").alias("role"), F.lit("").alias("text"))
    repaired = F.concat(F.flatten(F.zip_with("rows", macros, edits)), edits(none, F.regexp_extract(script, "((?:I.)*)$", 1)))
    return found.select(id_col, "gaps", *[F.col(f"plan.{c}") for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.regexp_replace(script, "([DIKR]).", "$1").alias("audit"), repaired.alias("repaired"))
