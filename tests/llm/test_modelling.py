"""Whitening, language-model scores and conversation repair against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from presswork.llm import lm, repair, whitening
from presswork.llm.sql import ORACLES
from pyspark.sql import functions as F

# --- whitening ---


@pytest.mark.parametrize("kind", ["random", "clustered", "diagonal", "low", "two"])
def test_leading_vectors(kind):
    random = np.random.default_rng(4)
    n = 2 if kind == "two" else 40
    a = random.normal(size=(n, n))
    if kind == "clustered":
        q = np.linalg.qr(a)[0]
        a = q @ np.diag([5.0] * 4 + [5 - 1e-9] * 3 + [3.0] * 3 + list(np.linspace(1, 2, n - 10))) @ q.T
    elif kind == "diagonal":
        a = np.diag(random.random(n))
    elif kind == "low":
        a = a[:, :3] @ a[:, :3].T
    a = a + a.T
    most = min(8, n)
    values, vectors = whitening.leading_vectors(a, most)
    want = np.linalg.eigvalsh(a)[::-1][:most]
    assert np.allclose(values, want, atol=1e-12 * np.abs(want).max())
    assert np.allclose(vectors.T @ vectors, np.eye(most), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * np.abs(want).max())


def whitened(rows, model):
    return {r.vec_id: r for r in whitening.whiten(rows, model).collect()}


def test_whitening(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    x = {r.vec_id: [math.floor(1024 * c) + 100_000 for c in r.embedding] for r in rows.collect()}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    model = whitening.fit(rows)
    got = whitened(rows, model)
    assert got.keys() == x.keys() and model.n == n and model.sums == sums
    z = np.array(list(x.values()), float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    signs = np.sign((vectors * model.vectors).sum(axis=0))
    plain = z @ (vectors * signs) / np.sqrt(values)
    assert np.allclose([got[i].whitened for i in x], plain, atol=1e-8)
    assert [int(got[i].deviation) for i in x] == [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.values()]
    assert np.allclose(model.explained, values / (z * z).sum() * n, rtol=1e-10) and model.identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 2.0, 0.5]), (2, [1.5, -2.0, 0.25]), (2, [1.5, -2.0, 0.25]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0]), (None, [0.0, 1.0, -7.0]), (9, [1e8, -1e8, 3.0])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumns({"whitened": F.lit("x"), "component": F.lit(1), "n": F.lit(2)})
    model = whitening.fit(rows)
    got = sorted(whitening.whiten(rows, model).collect(), key=repr)
    assert model.n == 5 and sorted(r.vec_id or 0 for r in got) == [0, 1, 2, 2, 9]
    assert len({repr(r) for r in got if r.vec_id == 2}) == 1 and len(model.values) <= 3
    huge = [r for r in got if r.vec_id == 9]
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in odd if i in (1, 2, None, 9)}
    sums = [x[1][i] + 2 * x[2][i] + x[None][i] + x[9][i] for i in range(3)]
    assert int(huge[0].deviation) == sum((5 * c - s) ** 2 for c, s in zip(x[9], sums))
    same = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for table in (same, rows.where("vec_id = 3"), rows.limit(0)):
        assert whitening.fit(table) is None and whitening.whiten(table, whitening.fit(table)).count() == 0


# --- language model ---


def plain_base(rows):
    """Base scores by plain counting."""
    def tokens(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        out, word = [], ""
        for c in text:
            if c in " \t\n\x0b\x0c\r":
                out += [word] * bool(word)
                word = ""
            else:
                word += c
        return out + [word] * bool(word) + [None]

    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in rows if i not in held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, i in held, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows), key=repr)


@pytest.mark.parametrize("table", ["documents", "odd", "none"])
def test_base_scores(request, table, monkeypatch):
    monkeypatch.setattr(lm, "BROADCAST_TOKENS", 500)  # the others meet their counts in the join
    docs = request.getfixturevalue(table).withColumns({"score": F.lit("x"), "n_tokens": F.lit("y"), "row": F.lit(1), "token": F.lit("z")})
    fitted = lm.fit(docs)
    got = lm.score(docs, fitted).withColumn("held", lm.held_out(F.col("doc_id"))).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == plain_base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    if table == "documents":
        unseen = [r for r in got if r.held]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_sum_to_one(documents):
    known, model, counts = lm.fit(documents)
    every = counts.collect()
    words = pa.array([r.token for r in every])
    classes = known.classes(words, known.places(words))
    assert sum(r.n for r in every) == known.total and len(every) == known.distinct
    room = known.shared_total + known.shared_distinct + 1.0
    within = np.where(classes < known.own, 1.0, (np.array([r.n for r in every]) + 1) / room[np.maximum(classes - known.own, 0)])
    context = np.array([[3, 1, 4, 1]] * model.classes, np.int32)
    chances = np.exp(model.log_probabilities(np.arange(model.classes, dtype=np.int32), context))
    unseen = (chances[known.own :] / room).sum()
    assert abs((chances[classes] * within).sum() + unseen - 1) < 1e-5


def test_a_step_of_training_raises_what_was_seen():
    model = lm.Bilinear.begun(np.ones(20))
    classes, n = np.tile(np.array([1, 2, 3, 4], np.int32), 50), np.array([200])
    context = model.contexts(classes, n)
    assert context[0].tolist() == [20] * 4 and context[5].tolist() == [1, 4, 3, 2]
    before = model.log_probabilities(classes, context).sum()
    noise = np.random.default_rng(1).integers(0, 20, lm.NOISE).astype(np.int32)
    for _ in range(30):
        model.step(classes, context, noise, np.full(20, np.log(lm.NOISE / 20), np.float32))
    assert model.log_probabilities(classes, context).sum() > before / 2


# --- conversation repair ---


def cheapest(signature):
    """The least (cost, audit) over states, row by row from the front."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                to = 3 if s == 2 else 2
                best[to] = min(best.get(to, (99999, "")), (c + 5, a + "I"))
        return best

    for letter in signature:
        after: dict[int, tuple[int, str]] = {}
        role, cut = letter.lower(), 5 * letter.isupper()
        for s, (c, a) in inserted(best).items():
            ways = [(s, 2, "D")]
            if letter != "-":
                to = 3 if s == 2 else 2
                ways.append((to, 1 + cut, "R"))
                if (role == "a") == (s == 2) and role in "ua":
                    ways.append((to, cut, "K"))
                if role == "s" and s == 0:
                    ways.append((1, cut, "K"))
            for to, cost, edit in ways:
                after[to] = min(after.get(to, (99999, "")), (c + cost, a + edit))
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def test_audits_of_all_short_signatures():
    every = ["".join(s) for n in range(5) for s in itertools.product("-suaoSUAO", repeat=n)]
    automaton = repair.Automaton()
    for signature in sorted(every, key=lambda s: s[::-1]):
        assert automaton.repair(signature) == cheapest(signature), signature
    assert automaton.made == len(every) - 1  # one node for each suffix
    assert len(automaton.kinds) < 1000


def test_audits_of_long_signatures():
    random = np.random.default_rng(2)
    every = {"".join(random.choice(list("ssuuuaaa-oUA"), size=random.integers(1, 60))) for _ in range(300)} | {"ua" * 20_000 + "u"}
    automaton = repair.Automaton()
    for signature in sorted(every, key=lambda s: s[::-1]):
        assert automaton.repair(signature) == cheapest(signature) if len(signature) < 100 else automaton.repair(signature)[0] == 2


ODD_TALK = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 5, "user", "cut off"), (1, None, None, None),
    (2, 0, "assistant", "First!"), (2, 1, "tool", "output."), (3, 0, "user", ""), (4, 0, "system", "Only."), (5, 3, "user", "a b. \n\t"), (5, 9, "assistant", "x" * 200_000),
    (None, 1, "user", "No id?"), (None, 2, "assistant", "Right."), (None, None, "user", "no turn"), (6, 1, "user", "same turn b."), (6, 1, "user", "same turn a."), (6, 2, "", "empty role."), (7, -(2**63), "user", "low."), (7, 2**63 - 1, "assistant", "high."),
] + [(i, t, r, f"Text {i} {t}.") for i in range(8, 40) for t, r in enumerate(["user", "assistant"] * 2)]


@pytest.mark.parametrize("table", ["data", "odd", "none"])
def test_repair(spark, data, table):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.read.parquet(f"{data}/conversations.parquet") if table == "data" else spark.createDataFrame(ODD_TALK if table == "odd" else [], schema)
    rows = rows.withColumns({"audit": F.lit("x"), "gone": F.lit(True), "cost": F.lit(3)})
    hurt = repair.damaged(repair.filled(rows))
    planned = repair.diagnosed_plans(hurt)
    got = repair.digests(hurt, planned)
    conversations = rows.where("coalesce(conv_id, 0) <> 7").select("conv_id", "turn", "role", "text").toArrow()
    duck = duckdb.connect()
    duck.register("conversations", conversations)
    found = duck.sql(ORACLES["op13_conversation_repair"])
    assert sorted(map(tuple, got.where("conv_id is distinct from 7").select(*found.columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
    digest = {r.conv_id: r.repaired_sha256 for r in got.collect()}
    assert len(digest) == rows.select("conv_id").distinct().count() == got.count()
    lines = {i: [] for i in digest}
    for r in repair.repaired(hurt, planned).collect():
        lines[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for i, found in lines.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert hashlib.sha256("\n".join(t for _, t in sorted(found)).encode()).hexdigest() == digest[i]
