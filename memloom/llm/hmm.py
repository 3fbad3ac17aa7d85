"""Hidden Markov language model with word counts of the whole corpus.

A word's *form* (first two and last three bytes, hashed to one of ``FORMS`` symbols) is emitted by a latent state; the
word itself is drawn from its form by the corpus counts: P(text) = HMM(forms) x prod (c + 0.1) / (C + 0.1 (V + 1)), with
c the word's count, C and V the tokens and distinct words of its form.  Every document ends in an end token.

Training: Baum-Welch.  Expected counts are summed symbol by symbol across partitions.  The first rounds go over the
corpus once, each over another share of its documents (``SHARES``, small ones first, since early parameters needn't many
counts); then ``rounds`` rounds sum over all training documents.  A training sequence is a segment of ``SEGMENT`` tokens,
so that segments are worked on side by side; each begins with the last token of the one before, which counts as the
state's context only, so every transition of a document counts once.  The state before that token is taken from the
chain's long run: this is the one approximation in training.  Scoring runs the scaled forward recursion over whole
documents, so the likelihood is exact.

Counts are never held in one place: each input partition is cut into blocks of about ``BLOCK_BYTES`` of text, tokenised
once; a block asks for its distinct words, a join answers with corpus counts, and a block's documents (as word numbers)
meet its answers again in one task.

Defined cases: a null text is empty and holds the end token alone; with no training documents every count is zero and
states are uniform; repeated rows are scored and counted as often as they occur; empty tables give no rows; a null id is
in the training fold; other columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table, written

STATES, FORMS, SEGMENT = 8, 4096, 64
#: Shares of the corpus, in 32nds, that the first rounds see; together they are the corpus.
SHARES = (1,) * 8 + (2,) * 4 + (4,) * 4
END, END_FORM = b"", FORMS
COLUMNS = ["block", "key", "held_out", "ids", "s", "w", "i", "form", "c"]
BLOCK_BYTES = 16_000_000
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(LOWER).split(), END]


class Forms(dict):
    """Word -> symbol, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        s = crc32(w[:2] + b"|" + w[-3:]) % FORMS if w else END_FORM
        self[w] = s
        return s


def start() -> dict[str, np.ndarray]:
    r = np.random.default_rng(20240304)
    emit = r.uniform(0.5, 1.5, (STATES, FORMS + 1))
    return {"first": np.full(STATES, 1 / STATES), "move": np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES), "emit": emit / emit.sum(1, keepdims=True)}


def expected(model: dict, segments: np.ndarray, opening: np.ndarray) -> dict[str, np.ndarray]:
    """Baum-Welch counts of segments: rows of a context symbol and SEGMENT symbols, -1 after the end.

    ``opening``: segments that begin a document; their context is none and is passed over.
    """
    # States are rows and segments columns; the symbol after an end is one more form, which every state emits with certainty.
    emit = np.hstack([model["emit"], np.ones((STATES, 1))]).astype(np.float32)
    move, first = model["move"].astype(np.float32), model["first"].astype(np.float32)[:, None]
    symbols = np.ascontiguousarray(np.where(segments < 0, FORMS + 1, segments).T)
    a = np.linalg.matrix_power(model["move"], 256)[0].astype(np.float32)[:, None] * emit[:, symbols[0]]
    alpha = np.empty((SEGMENT + 1, STATES, len(segments)), dtype=np.float32)
    for t in range(SEGMENT + 1):
        if t:
            a = move.T @ a
            if t == 1:
                a[:, opening] = first
            a *= emit[:, symbols[t]]
        a /= a.sum(0)
        alpha[t] = a
    moves, beta = np.zeros((STATES, STATES)), np.ones((STATES, len(segments)), dtype=np.float32)
    for t in range(SEGMENT, 0, -1):
        ahead = emit[:, symbols[t]] * beta
        back = move @ ahead
        weight = alpha[t - 1] / (alpha[t - 1] * back).sum(0)
        weight *= (symbols[t] <= FORMS) & ~opening if t == 1 else symbols[t] <= FORMS
        moves += weight @ ahead.T
        gamma = alpha[t]  # from here on the state's probability given the whole segment
        gamma *= beta
        gamma /= gamma.sum(0)
        beta = back / back.sum(0)
    flat = symbols[1:].ravel()
    counts = [np.bincount(flat, weights=alpha[1:, k].ravel(), minlength=FORMS + 2)[: FORMS + 1] for k in range(STATES)]
    return {"first": alpha[1][:, opening].sum(1, dtype=np.float64), "move": moves * model["move"], "emit": np.stack(counts, axis=1)}


def better(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters from expected counts, with a little mass everywhere."""
    grow = lambda x, add: (x + add) / (x + add).sum(-1, keepdims=True)
    return {"first": grow(counts["first"], 0.1), "move": grow(counts["move"], 0.1), "emit": grow(counts["emit"].T, 0.01)}


def forward(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each symbol sequence."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    out = np.zeros(len(rows))
    emit = np.ascontiguousarray(model["emit"].T)
    for lo in range(0, len(order), 2048):
        mine = order[lo : lo + 2048]
        n = np.array([len(rows[i]) for i in mine])
        flat = np.concatenate([rows[i] for i in mine])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
        a, total = np.tile(model["first"], (len(mine), 1)), np.zeros(len(mine))
        for t in range(int(n[0])):
            m = live[t]
            a = (a[:m] if t == 0 else a[:m] @ model["move"]) * emit[flat[begin[:m] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:m] += np.log(scale)
        out[mine] = total / math.log(10)
    return out


def cut(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of the sequences, each after its context symbol, and which of them begin one."""
    n = np.array([-(-len(s) // SEGMENT) for s in symbols])
    grid = np.full((int(n.sum()), SEGMENT + 1), -1, dtype=np.int64)
    at = 0
    for s, k in zip(symbols, n, strict=True):
        whole = np.full(k * SEGMENT, -1, dtype=np.int64)
        whole[: len(s)] = s
        grid[at : at + k, 1:] = whole.reshape(k, SEGMENT)
        at += k
    opening = np.zeros(len(grid), dtype=bool)
    opening[np.cumsum(n) - n] = True
    grid[1:, 0] = grid[:-1, -1]
    grid[opening, 0] = -1
    return grid, opening


def blocks_of(docs: DataFrame, kind: str) -> DataFrame:
    """Documents (block, key, held_out, ids, s, i) and their blocks' words (block, w, i, form, c) in one table.

    i: number of the document in its partition, or of the word in its block; ids: word numbers within the block; s: forms; c: the word's count in the block's training documents.
    """

    def run(batches):
        from pyspark import TaskContext

        block, forms = TaskContext.get().partitionId() << 24, Forms()
        number: dict[bytes, int] = {}
        mine, rows, size, at = [], [], 0, 0

        def docs_out():
            out = pd.DataFrame(rows, columns=["key", "held_out", "ids", "s", "i"]).assign(block=block, w=None, form=None, c=None)
            rows.clear()
            return out[COLUMNS]

        def words_out():
            c = np.bincount(np.concatenate(mine), minlength=len(number)) if mine else np.zeros(len(number), dtype=np.int64)
            words = list(number)
            for lo in range(0, len(words), 50_000):
                w = words[lo : lo + 50_000]
                yield pd.DataFrame({"block": block, "key": None, "held_out": None, "ids": None, "s": None, "w": w, "i": range(lo, lo + len(w)), "form": [forms[x] for x in w], "c": c[lo : lo + len(w)]})[COLUMNS]

        for pdf in batches:
            for k, out, t in zip(pdf["key"], pdf["held_out"], pdf["text"]):
                ws = tokens(t)
                ids = np.array([number.setdefault(w, len(number)) for w in ws], dtype="<u4")
                rows.append((k, out, ids.tobytes(), np.array([forms[w] for w in ws], dtype="<u2").tobytes(), at))
                at += 1
                if not out:
                    mine.append(ids)
                size += len(t)
                if len(rows) >= 500:
                    yield docs_out()
                if size >= BLOCK_BYTES:
                    yield docs_out()
                    yield from words_out()
                    number.clear()
                    mine.clear()
                    block, size = block + 1, 0
        yield docs_out()
        yield from words_out()

    return docs.mapInPandas(run, f"block long, key {kind}, held_out boolean, ids binary, s binary, w binary, i int, form int, c long")


def train(texts: DataFrame, rounds: int, blocks: int) -> dict[str, np.ndarray]:
    """Parameters from ``texts`` (block, i, s) of some ``blocks`` blocks."""
    spark, model = texts.sparkSession, start()
    columns = [f"g{k}" for k in range(STATES)]
    # Block and number make a row's hash, so copies of a text spread over the shares.
    share, at, rows_of = F.pmod(F.xxhash64("block", "i"), F.lit(sum(SHARES))), 0, []
    for width in SHARES:
        # A share is read by as many tasks as it needs, so that few partial sums come of it.
        rows_of.append(texts.where((share >= at) & (share < at + width)).coalesce(max(2, 4 * blocks * width // sum(SHARES))))
        at += width
    for symbols in [*rows_of, *[texts] * rounds]:
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            total = None
            for pdf in batches:
                for lo in range(0, len(pdf), 1000):
                    grid, opening = cut([np.frombuffer(s, dtype="<u2").astype(np.int64) for s in pdf["s"].iloc[lo : lo + 1000]])
                    for k in range(0, len(grid), 8192):
                        part = expected(sent.value, grid[k : k + 8192], opening[k : k + 8192])
                        total = part if total is None else {x: total[x] + part[x] for x in total}
            if total is not None:
                rows = np.vstack([total["emit"], total["move"], total["first"]])
                yield pd.DataFrame(rows, columns=columns).assign(i=range(len(rows)))[["i", *columns]]

        sums = symbols.select("s").mapInPandas(run, "i int, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns])
        # One row a symbol and state, however large the corpus.
        rows = sums.toPandas().sort_values("i")[columns].to_numpy()
        if len(rows):  # a small corpus has no document in some shares
            model = better({"emit": rows[: FORMS + 1], "move": rows[FORMS + 1 : FORMS + 1 + STATES], "first": rows[-1]})
        sent.destroy()
    return model


def score(docs: DataFrame, *, rounds: int = 2, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; rows with crc32(key) mod ``folds`` = 0 are held out."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(crc_mod(F.col(key), folds) == 0, F.lit(False)).alias("held_out"))
    read = written(blocks_of(rows, kind))
    words, texts = read.where("w is not null").select("block", "w", "i", "form", "c"), read.where("ids is not null")
    counts = written(words.where("c > 0").groupBy("w").agg(F.sum("c").alias("total")))

    def by_form(batches):
        for pdf in batches:
            forms = Forms()
            s = np.array([forms[bytes(w)] for w in pdf["w"]], dtype=np.int64)
            tokens_, words = np.bincount(s, weights=pdf["total"], minlength=FORMS + 1), np.bincount(s, minlength=FORMS + 1)
            yield pd.DataFrame({"s": np.arange(FORMS + 1), "c": tokens_.astype(np.int64), "v": words})[words > 0]

    forms = counts.mapInPandas(by_form, "s int, c long, v long").groupBy("s").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    in_form, kinds = np.zeros(FORMS + 1), np.zeros(FORMS + 1)
    in_form[forms["s"].astype(int)], kinds[forms["s"].astype(int)] = forms["c"], forms["v"]
    total, distinct = int(in_form.sum()), int(kinds.sum())
    blocks = read.agg(F.count_distinct("block")).first()[0]
    model = train(texts.where("not held_out").select("block", "i", "s"), rounds, blocks)
    sent = spark.sparkContext.broadcast((model, np.log10(in_form + 0.1 * (kinds + 1))))
    whole = math.log10(total + 0.1 * (distinct + 1))

    def run(docs_: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        model_, mass = sent.value
        answers = answers.sort_values("i")
        logs, known, symbol = np.log10(answers["total"].to_numpy() + 0.1), answers["total"].to_numpy() > 0, answers["form"].to_numpy().astype(np.int64)
        out = []
        for lo in range(0, len(docs_), 2048):
            lists = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in docs_["ids"].iloc[lo : lo + 2048]]
            likely = forward(model_, [symbol[x] for x in lists])
            for k, x in enumerate(lists):
                lexical = logs[x].sum()
                out.append((len(x), int(known[x].sum()), lexical - len(x) * whole, likely[k] + lexical - mass[symbol[x]].sum()))
        done = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        return pd.concat([docs_[["key", "held_out"]].reset_index(drop=True), done], axis=1).assign(train_tokens=total)[["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    answered = words.join(counts, "w", "left").select("block", "i", "form", F.coalesce("total", F.lit(0)).alias("total"))
    # Twice as many partitions as blocks, so that few of them hold several.
    tasks = 2 * blocks + 1
    mine = texts.select(F.col("block").alias("b"), "key", "held_out", "ids").repartition(tasks, "b").groupBy("b").cogroup(answered.repartition(tasks, "block").groupBy("block"))
    scored = mine.applyInPandas(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("key", key)


def op5_hidden_markov(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
