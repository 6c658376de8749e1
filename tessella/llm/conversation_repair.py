"""Repair of conversation structure with a suffix-shared automaton of role and fault signatures.

Every row of a conversation becomes one symbol: its role's initial (system, user,
assistant or other) and whether it is sound, truncated, or must go (blank or
repeated). The word of symbols is the conversation's signature. Cheapest edits
depend on the signature alone, and from any row on only on the rest of it, so
equal signatures are solved once and common endings are shared: signatures are
ordered from their ends, and the automaton grows by the symbols in which the
next one differs. A node keeps, for every grammar state, the cost to go and the
first edits of the best audit; nodes whose costs differ by a constant are one.

Grammar states: nothing yet, after system, after user, after assistant. The
result reads as an optional system row and one or more user and assistant pairs,
or nothing at all.

Scale: rows without their texts are counted by content before any shuffle that
brings equal rows together, and signatures are cut from ranges of the order
(conversation, turn, role, digest of the text), so a conversation of any size is
spread over ranges. Its signature is put together in one cell, a byte a row, as
its audit must be. The digest of the repaired text is serial by definition: the
rows of a conversation stream through one task in order, none is held.

Edge cases: null roles and texts are one space; a null turn comes first and
counts for no gap; a null conversation id is a conversation; equal turns are
ordered by role and the MD5 of the text; an empty role has an initial of its own
that no state takes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

#: Next grammar state by (state, initial); states: 0 nothing, 1 system, 2 user, 3 assistant.
TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a user or assistant row is put in, and its role, by state.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Edits that close a conversation, by state.
CLOSE = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = {"su", "ua", "au"}


class Automaton:
    """Solved suffixes of signatures, which must come ordered by their reversed text."""

    def __init__(self) -> None:
        self.known: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = {}
        self.text = ""  # of the open path, from the end
        self.path: list[tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = [(tuple(len(CLOSE[s]) * INSERT for s in range(4)), 0, ())]
        self.nodes = 0

    def step(self, after: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
        """(costs by state less their least, that least, first edits and next state by state) before ``symbol``."""
        extra = TRUNCATED if symbol.isupper() else 0
        own: list[list[tuple[int, str, int]]] = []
        for s in range(4):
            edits = [(DELETE + after[s], "D", s)]
            if symbol != "x":
                if (to := TAKES.get((s, symbol.lower()))) is not None:
                    edits.append((KEEP + extra + after[to], "K", to))
                edits.append((REROLE + extra + after[NEXT[s]], "R", NEXT[s]))
            own.append(edits)
        best = []
        for s in range(4):
            edits, at = list(own[s]), s
            for k in (1, 2):  # a third insertion comes back to a state already tried
                at = NEXT[at]
                edits += [(cost + k * INSERT, "I" * k + letter, to) for cost, letter, to in own[at]]
            best.append(min(edits))
        least = min(b[0] for b in best)
        return tuple(b[0] - least for b in best), least, tuple((b[1], b[2]) for b in best)

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature."""
        turned = signature[::-1]
        shared = 0
        for a, b in zip(turned, self.text):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for symbol in turned[shared:]:
            after, base, _ = self.path[-1]
            if (after, symbol) not in self.known:
                self.known[after, symbol] = self.step(after, symbol)
            costs, least, edits = self.known[after, symbol]
            self.path.append((costs, base + least, edits))
            self.nodes += 1
        self.text = turned
        state, audit = 0, []
        for _, _, edits in reversed(self.path[1:]):
            letters, state = edits[state]
            audit.append(letters)
        audit.append(CLOSE[state])
        costs, base, _ = self.path[-1]
        return base + costs[0], "".join(audit)


def _key(conv: str) -> Column:
    """A text that tells a null id from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(k, t, role, h, text): rows under clear names, with the digest that orders and tells texts apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        _key(conv).alias("k"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.md5(body.cast("binary"))).alias("h"), body.alias("text"),
    )


def fragments(lines: DataFrame) -> DataFrame:
    """What each range holds of each conversation: a piece of its signature, counts and borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for k, group in groupby(stream(), lambda r: r[0]):
            signature, last, first = bytearray(), "", ""
            blank = duplicate = truncated = illegal = turns = 0
            low = high = None
            for _, t, initial, n, is_blank, is_cut, again in group:
                twice = 0 if is_blank else n if again else n - 1
                once = 0 if is_blank or again else 1
                blank += n if is_blank else 0
                duplicate += twice
                truncated += once if is_cut else 0
                signature += (initial.upper() if is_cut else initial).encode() * once + b"x" * (n - once)
                illegal += n - 1 + (1 if last and last + initial not in LEGAL else 0)
                last, first = initial, first or initial
                if t is not None and t != high:
                    turns, high, low = turns + 1, t, t if low is None else low
            out.append((k, part, signature.decode(), first, last, blank, duplicate, truncated, illegal, low, high, turns))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), kinds)], names)

    names = ["k", "part", "sig", "first", "last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 7]
    schema = "k string, part int, sig string, first string, last string, " + ", ".join(f"{c} long" for c in names[5:])
    order = [F.col("k"), F.col("t").asc_nulls_first(), F.col("role"), F.col("h")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("k", "t", "initial", "n", "is_blank", "is_cut", "again").mapInArrow(run, schema)


def signatures(rows: DataFrame) -> DataFrame:
    """(k, sig, gaps, blank, duplicate, truncated, illegal) of the rows of :func:`_rows`."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    head = F.substring("role", 1, 1)
    light = rows.select(
        "k", "t", "role", "h", F.when(head.isin("s", "u", "a"), head).otherwise(F.lit("o")).alias("initial"),
        (body == "").alias("is_blank"), ((body != "") & ~F.substring(body, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    counted = written(light.groupBy("k", "t", "role", "h").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("initial", "is_blank", "is_cut")]), "rows")
    at = F.struct(F.col("t").isNotNull().alias("o"), F.col("t").alias("t"))
    first = counted.groupBy(F.col("k").alias("k2"), F.col("role").alias("r2"), F.col("h").alias("h2")).agg(F.min(at).alias("since"))
    same = (F.col("k") == F.col("k2")) & (F.col("role") == F.col("r2")) & (F.col("h") == F.col("h2"))
    lines = written(counted.join(first, same).withColumn("again", ~F.col("t").eqNullSafe(F.col("since.t"))).drop("k2", "r2", "h2", "since"), "lines")
    parts = fragments(lines).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "sig", "first", "last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"))).alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[c])
    border = lambda f: F.aggregate(F.sequence(F.lit(2), F.size("p")), F.lit(0).cast("long"), lambda a, i: a + F.when(f(F.element_at("p", i - 1), F.element_at("p", i)), 1).otherwise(0))
    across = lambda f: F.when(F.size("p") > 1, border(f)).otherwise(F.lit(0))
    turns = total("turns") - across(lambda a, b: a["high"].eqNullSafe(b["low"]) & a["high"].isNotNull())
    span = F.array_max(F.transform("p", lambda x: x["high"])) - F.array_min(F.transform("p", lambda x: x["low"])) + 1
    return parts.select(
        "k", F.array_join(F.transform("p", lambda x: x["sig"]), "").alias("sig"), F.coalesce(span - turns, F.lit(0)).cast("long").alias("gaps"),
        total("blank").alias("blank"), total("duplicate").alias("duplicate"), total("truncated").alias("truncated"),
        (total("illegal") + across(lambda a, b: ~F.concat(a["last"], b["first"]).isin(*LEGAL))).alias("illegal"),
    )


def audits(sigs: DataFrame) -> DataFrame:
    """(sig, cost, audit) of distinct signatures; ranges of reversed signatures share their endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for b in batches:
            got = [automaton.solve(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], ["sig", "cost", "audit"])

    distinct = written(sigs.select("sig").distinct(), "signatures")
    return distinct.repartitionByRange(F.reverse("sig")).sortWithinPartitions(F.reverse("sig")).mapInArrow(run, "sig string, cost long, audit string")


def _verdicts(rows: DataFrame) -> DataFrame:
    found = written(signatures(rows), "verdicts")
    solved = audits(found).withColumnRenamed("sig", "sig2")
    return written(found.join(solved, F.col("sig") == F.col("sig2")).drop("sig", "sig2"), "audits")


def _named(out: DataFrame, kind: str) -> DataFrame:
    """The conversation's id in its own type in place of the key."""
    ident = F.when(F.col("k") != "", F.expr("substr(k, 2)")).cast(kind)
    return out.select(ident.alias("conv_id"), *[c for c in out.columns if c != "k"])


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    return _named(_verdicts(_rows(rows, conv_col, turn_col, role_col, text_col)), rows.schema[conv_col].dataType.simpleString())


def edited(stream: Iterator[tuple[str, int, str, str]]) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    """(conversation, its repaired (role, text) rows) from rows in order, each conversation headed by its audit (kind 0)."""

    def carry_out(group: Iterator[tuple[str, int, str, str]]) -> Iterator[tuple[str, str]]:
        letters, state = iter(next(group)[3]), 0
        for _, _, role, text in group:
            while (edit := next(letters)) == "I":
                state = NEXT[state]
                yield ROLE[state], ""
            if edit == "K":
                state = TAKES[state, role[0]]
                yield role, text
            elif edit == "R":
                state = NEXT[state]
                yield ROLE[state], text
        for _ in letters:
            state = NEXT[state]
            yield ROLE[state], ""

    for k, group in groupby(stream, lambda r: r[0]):
        yield k, carry_out(group)


def _in_order(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    heads = verdicts.select("k", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("h"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)))
    return both.repartition("k").sortWithinPartitions("k", "kind", F.col("t").asc_nulls_first(), "role", "h").select("k", "kind", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def repaired_rows(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, block, held = ["k", "position", "role", "text"], [], 0
        for k, lines in edited(_stream(batches)):
            for n, (role, text) in enumerate(lines):
                block.append((k, n, role, text))
                held += len(text) + 50
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block)], names)
                    block, held = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block)], names)

    plain = _rows(rows, conv_col, turn_col, role_col, text_col)
    out = _in_order(plain, _verdicts(plain)).mapInArrow(run, "k string, position long, role string, text string")
    return _named(out, rows.schema[conv_col].dataType.simpleString())


def repair_with_digest(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`repair` with ``repaired_sha256``: lowercase hex of the repaired ``role:text`` lines joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[str, str]] = []
        for k, lines in edited(_stream(batches)):
            digest = hashlib.sha256()
            for n, (role, text) in enumerate(lines):
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            block.append((k, digest.hexdigest()))
            if len(block) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block)], ["k2", "repaired_sha256"])
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block)], ["k2", "repaired_sha256"])

    plain = _rows(rows, conv_col, turn_col, role_col, text_col)
    verdicts = _verdicts(plain)
    digests = _in_order(plain, verdicts).mapInArrow(run, "k2 string, repaired_sha256 string")
    out = verdicts.join(digests, F.col("k") == F.col("k2")).drop("k2")
    return _named(out, rows.schema[conv_col].dataType.simpleString())


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: (conv_id, turn, role, text), a CRC of conversation and turn deciding which row gets which."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20)).cast("int")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("_f"))
    return changed.where("_f != 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_f") == 3, 2).otherwise(1))).alias("_c")).drop("_c")
