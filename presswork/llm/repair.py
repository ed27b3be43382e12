"""Repair of conversations at least cost, by an automaton of shared suffixes.

A row of a conversation is one letter of a signature: its role's initial, in capitals where the text is cut off, or ``-``
where it must go (blank, or seen before). Signatures that repeat are kept once. Read from their ends, and sorted so, signatures with a
common suffix follow each other; a node of the automaton is one suffix, and its costs to go, from each state of the
grammar ``(s?(ua)+)?``, are computed once, from the node of the suffix that is shorter by one. From a node and state each
edit leads to one successor only, so among edits of equal cost the least letter gives the least audit. The audits go
back to the conversations, whose rows are then read once more, in order, and edited as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from presswork.shared import written

#: Costs of the edits, and of leaving a row that is cut off.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_OFF = 5
#: Blanks, and what may end a whole text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States of the grammar: begun, after a system row, after a user row, after an assistant row. An inserted or renamed row
#: is of the role that a state waits for.
START, SYSTEM, USER, ASSISTANT = range(4)
WAITS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
#: First characters of a text by which rows of one turn and role are ordered, before a digest of the whole.
PREFIX = 64
#: What no state can reach at the end of all rows, and the mark of an end without edits.
_NEVER, DONE = 1 << 60, "."


# --- the automaton ---


def _moved(state: int, letter: str) -> int | None:
    """The state that a kept row leads to, if it may be kept."""
    if state == START and letter == "s":
        return SYSTEM
    return WAITS[state][1] if letter == WAITS[state][0] else None


def _with_inserts(costs: list[int], letters: list[str]) -> tuple[tuple[int, ...], str]:
    """Costs and first edits of a node once rows may be inserted before what follows."""
    for _ in range(3):  # an insertion changes the state, of which two only follow each other
        for state in range(4):
            cost = COSTS["I"] + costs[WAITS[state][1]]
            if cost < costs[state] or (cost == costs[state] and "I" < letters[state]):
                costs[state], letters[state] = cost, "I"
    return tuple(costs), "".join(letters)


class Automaton:
    """Nodes along the suffixes of one signature after the other; what two signatures share at their ends is computed
    once, if they come in the order of their reversed letters.

    A node's costs are kept relative to the least of them: so few kinds of nodes occur, and a step from one kind by one
    letter is computed once for all nodes.
    """

    def __init__(self) -> None:
        costs, letters = _with_inserts([0, _NEVER, _NEVER, 0], [DONE, "~", "~", DONE])
        self.kinds: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], str, int]] = {}
        self.read, self.nodes, self.made = "", [(costs, letters, 0)], 0  # costs above the least, first edits, the least

    def _step(self, letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str, int]:
        found = self.kinds.get((letter, after))
        if found is None:
            costs, letters = [], []
            role, cut = letter.lower(), CUT_OFF * letter.isupper()
            for state in range(4):
                ways = [(COSTS["D"] + after[state], "D")]
                if letter != "-":
                    ways.append((COSTS["R"] + cut + after[WAITS[state][1]], "R"))
                    kept = _moved(state, role)
                    if kept is not None:
                        ways.append((COSTS["K"] + cut + after[kept], "K"))
                cost, first = min(ways)
                costs.append(cost)
                letters.append(first)
            whole, first = _with_inserts(costs, letters)
            least = min(whole)
            found = self.kinds[letter, after] = tuple(c - least for c in whole), first, least
        return found

    def repair(self, signature: str) -> tuple[int, str]:
        """The least cost, and the least audit of that cost."""
        reverse = signature[::-1]
        shared = 0
        for a, b in zip(reverse, self.read):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for letter in reverse[shared:]:
            costs, _, least = self.nodes[-1]
            made, first, more = self._step(letter, costs)
            self.nodes.append((made, first, least + more))
            self.made += 1
        self.read = reverse
        at, state, audit = len(reverse), START, []
        while True:
            edit = self.nodes[at][1][state]
            if edit == DONE:
                break
            audit.append(edit)
            if edit == "K":
                state = _moved(state, reverse[at - 1].lower())
            elif edit != "D":
                state = WAITS[state][1]
            at -= edit != "I"
        return self.nodes[-1][0][START] + self.nodes[-1][2], "".join(audit)


def plans(signatures: DataFrame, signature: str = "signature") -> DataFrame:
    """``(signature, cost, audit)`` of every distinct signature. They are dealt by ranges of their reversed letters, so those
    that end alike meet, and a frequent signature is one row."""
    once = written(signatures.select(F.col(signature).alias("signature")).where("signature is not null").distinct().withColumn("reverse", F.reverse("signature")), "signatures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            made = [automaton.repair(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in made], pa.int64()), pa.array([a for _, a in made], pa.string())], ["signature", "cost", "audit"])

    return once.repartitionByRange("reverse").sortWithinPartitions("reverse").select("signature").mapInArrow(run, "signature string, cost long, audit string")


# --- conversations ---


def filled(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` of a table's rows: null roles and texts as one space, and none gone."""
    space = F.lit(" ")
    return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), F.lit(False).alias("gone"))


def damaged(rows: DataFrame) -> DataFrame:
    """Filled rows with known damage, by a checksum of conversation and turn (nulls: one space): rows gone (they are kept to
    name their conversation), texts emptied or without their stops, rows repeated, roles overwritten."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    once = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"),
    )
    return once.select("conv_id", "turn", "role", "text", "gone", F.explode("times").alias("time")).drop("time")


def _in_order(digest: bool) -> list[Column]:
    """The order of a conversation's rows; equal rows are alike."""
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("prefix") if digest else F.substring("text", 1, PREFIX), F.col("digest") if digest else F.md5("text")]


def diagnosed(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, signature)`` of every conversation of ``rows(conv_id, turn, role,
    text, gone)``, from its rows that aren't gone; each row's first fault counts.

    Rows go by turn (nulls first), role and text. A null conversation is one too. Of texts, 64 characters, a digest and
    the last solid character are shuffled. A conversation's rows are sorted, with spills, and pass one by one, so one
    that holds a large part of all rows takes time and no memory but a byte a row.
    """
    thin = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "gone", F.substring("text", 1, PREFIX).alias("prefix"), F.md5("text").alias("digest"),
        F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).alias("last"),
    )
    own = W.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"))
    seen = thin.repartition("conv_id").withColumn("seen", F.row_number().over(own) > 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(F.col("last") == "", "b").when(F.col("seen"), "d").when(F.instr(F.lit(ENDS), F.col("last")) == 0, "t").otherwise("k")
    marked = seen.select("conv_id", "turn", "role", "prefix", "digest", "gone", letter.alias("fault"), initial.alias("initial"))
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), *_in_order(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        begun, conv, made, counts, illegal, last, turns, low, high, before = False, None, bytearray(), {}, 0, None, 0, None, None, None

        def done() -> tuple:
            gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
            return conv, gaps, counts.get("b", 0), counts.get("d", 0), counts.get("t", 0), illegal, made.decode()

        for batch in batches:
            for conv_id, turn, gone, fault, role in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "fault", "initial"))):
                if not begun or conv_id != conv:
                    if begun:
                        held.append(done())
                    begun, conv, made, counts, illegal, last, turns, low, high, before = True, conv_id, bytearray(), {}, 0, None, 0, None, None, None
                if gone:
                    continue
                if turn is not None:
                    low, high, turns, before = turn if low is None else low, turn, turns + (turn != before), turn
                counts[fault] = counts.get(fault, 0) + 1
                illegal += last is not None and last + role not in ("su", "ua", "au")
                last = role
                known = role if role in ("s", "u", "a") else "o"
                made += b"-" if fault in "bd" else (known.upper() if fault == "t" else known).encode()
            if held:
                yield _rows(held)
                held = []
        if begun:
            yield _rows([done()])

    def _rows(items: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items), (kind, *[pa.int64()] * 5, pa.string()))], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    return ordered.select("conv_id", "turn", "gone", "fault", "initial").mapInArrow(run, schema)


def diagnosed_plans(rows: DataFrame) -> DataFrame:
    """What ``diagnosed`` gives, with the cost and the audit of each conversation's repair."""
    found = written(diagnosed(rows), "diagnosed")
    return written(found.join(plans(found), "signature").drop("signature"), "repair-plans")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, object]]:
    """Over rows in order, each conversation's audit before its rows: ``(0, audit, (conversation, ...))``, then ``(1, role, text)``
    of each repaired row."""
    audit, at, state = "", 0, START

    def inserted() -> Iterator[tuple[int, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            letter, state = WAITS[state]
            at += 1
            yield 1, ROLES[letter], ""

    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            item = dict(zip(names, row))
            if item["audit"] is not None:
                yield from inserted()
                audit, at, state = item["audit"], 0, START
                yield 0, audit, item
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            role = item["role"]
            if edit == "R":
                letter, state = WAITS[state]
                role = ROLES[letter]
            elif edit == "K":
                state = _moved(state, role[:1])
            if edit != "D":
                yield 1, role, item["text"]
    yield from inserted()


def _with_audits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows, in order, within one partition."""
    heads = planned.withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    body = rows.where(~F.col("gone")).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), *_in_order(False))


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)`` of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, held = None, 0, []

        def block() -> pa.RecordBatch:
            ids, places, roles, texts = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "position", "role", "text"])

        for sort, role, text in _edited(batches):
            if sort == 0:
                conv, position = text["conv_id"], 0
                continue
            held.append((conv, position, role, text))
            position += 1
            if len(held) == 1000:
                yield block()
                held = []
        if held:
            yield block()

    return _with_audits(rows, planned).mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The plans, and the SHA-256 of each repaired conversation (``role:text`` lines). The digest is a chain, so it is taken as
    the rows pass."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [to_arrow_type(planned.schema[n].dataType) for n in names] + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, chain, lines, held = None, None, 0, []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], [*names, "repaired_sha256"])

        for sort, role, text in _edited(batches):
            if sort == 0:
                if head is not None:
                    held.append((*head, chain.hexdigest()))
                if len(held) >= 1000:
                    yield block()
                    held = []
                head, chain, lines = tuple(text[n] for n in names), hashlib.sha256(), 0
                continue
            chain.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
            lines += 1
        if head is not None:
            held.append((*head, chain.hexdigest()))
            yield block()

    schema = ", ".join(f"{n} {planned.schema[n].dataType.simpleString()}" for n in names) + ", repaired_sha256 string"
    return _with_audits(rows, planned).select(*names, "turn", "role", "text").mapInArrow(run, schema)
