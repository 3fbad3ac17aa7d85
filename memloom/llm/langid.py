"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled passages.  A text is parsed greedily into the longest phrases that
occur in a language's passages; the language needing the fewest phrases, normalised by the bits that name a phrase
(log2 of the passages' length) and by the text's length, wins (Ziv-Merhav cross-entropy).

The fit uses a bounded sample: at most ``passages`` passages of at most ``passage_chars`` characters per language, so
at most a few ten thousand characters each; whole texts are scored.  An automaton's memory follows its transitions (at
most three a character), whatever the alphabet.  Texts are scored in lockstep: pieces of ``PIECE`` letters are lanes of
one numpy step, and phrases end at piece boundaries.

Defined cases: a null text, or one without any letter, gives ``und`` and score 0; with no labelled passages every text
gives ``und``; ties go to the first language by name and score 0; repeated rows count as often as they occur; a null key
is not held out; empty tables give no rows; other columns are kept as they are, and a table that has a column named like
``into`` is refused.
"""

from __future__ import annotations

import random
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import added, crc_mod, table

#: Letters of a lane; lanes of one step.
PIECE, LANES = 2048, 4096
SEPARATOR, UNKNOWN = 0, 1
#: A text without any match is ``und``.
LETTER = r"\p{L}"


def suffix_automaton(strings: list[list[int]]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of the strings; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]
    for s in strings:
        last = 0
        for c in s:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur
    return nxt


def packed(states: list[dict[int, int]], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): the transition of state q by c is ``target[base[q] + c]`` if ``owner[base[q] + c]`` is q.

    Rows of transitions overlap in one array (row displacement), so its size follows the transitions, not states times
    symbols: states with several are laid at random places that suit them, widest first; those with one fill the gaps.
    """
    edges = sum(map(len, states))
    size = 2 * edges + 2 * width + 16
    owner, target, base = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(len(states), dtype=np.int32)
    r, taken = random.Random(seed), bytearray(size)
    wide = sorted((i for i, row in enumerate(states) if len(row) > 1), key=lambda i: -len(states[i]))
    for q in wide:
        row = states[q]
        while True:
            at = r.randrange(size - width)
            if not any(taken[at + c] for c in row):
                break
        base[q] = at
        for c, j in row.items():
            taken[at + c], owner[at + c], target[at + c] = 1, q, j
    free = iter(np.flatnonzero(np.frombuffer(taken, dtype=np.uint8)[width : size - width] == 0) + width)
    for q, row in enumerate(states):
        if len(row) == 1:
            ((c, j),) = row.items()
            at = int(next(free))
            base[q], owner[at], target[at] = at - c, q, j
    return base, owner, target


class CrossParser:
    """Automata of all languages, their transitions packed into one array; a language's letters that no passage holds are its UNKNOWN.

    Letters are numbered for all languages together; each language has its own numbers where it knows them, so an alphabet
    of thousands of letters widens no other language.
    """

    def __init__(self, passages: dict[str, list[str]]):
        self.langs = sorted(passages)
        own = [sorted({c for p in passages[lang] for c in p.lower() if c.isalpha()}) for lang in self.langs]
        code = {c: i + 2 for i, c in enumerate(sorted(set().union(*own)))}
        # Code point -> symbol; letters that no passage holds are UNKNOWN and never match.
        self.symbol = np.full(sys.maxunicode + 1, SEPARATOR, dtype=np.int32)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha() or unicodedata.category(c)[0] == "L":
                self.symbol[cp] = code.get(c.lower(), UNKNOWN)
        self.bits, bases, owners, targets, at, slot = [], [], [], [], 0, 0
        # of[lang, symbol]: the language's own number of it; root[lang, own number]: the state after it from the start.
        self.of = np.full((len(self.langs), len(code) + 2), UNKNOWN, dtype=np.int32)
        self.of[:, SEPARATOR] = SEPARATOR
        widest = max([len(x) for x in own], default=0) + 2
        self.root = np.zeros((len(self.langs), widest), dtype=np.int32)
        for k, lang in enumerate(self.langs):
            for i, c in enumerate(own[k]):
                self.of[k, code[c]] = i + 2
            strings = [self.of[k, self.symbols(p)].tolist() for p in passages[lang]]
            states = suffix_automaton(strings)
            self.bits.append(np.log2(2 + sum(map(len, strings))))
            base, owner, target = packed(states, len(own[k]) + 2, k)
            lost = at + len(states)  # after a letter that no passage holds; such a letter is a phrase of its own
            self.root[k] = lost
            for c, j in states[0].items():
                self.root[k, c] = at + j
            bases += [base + slot, np.full(1, slot, dtype=np.int32)]
            owners.append(np.where(owner >= 0, owner + at, -1))
            targets.append(target + at)
            at, slot = lost + 1, slot + len(owner)
        if self.langs:
            self.base, self.owner, self.target = np.concatenate(bases), np.concatenate(owners).astype(np.int32), np.concatenate(targets).astype(np.int32)
        self.bits = np.array(self.bits)

    def symbols(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        keep = s != SEPARATOR
        keep[1:] |= s[:-1] != SEPARATOR  # one blank between words
        return s[keep]

    def phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece for each language."""
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        sizes = np.array([len(pieces[i]) for i in order])
        out = np.zeros((len(pieces), len(self.langs)), dtype=np.int64)
        for lo in range(0, len(order), LANES):
            mine, n = order[lo : lo + LANES], sizes[lo : lo + LANES]
            grid = np.zeros((int(n[0]), len(mine)), dtype=np.int32)
            for k, i in enumerate(mine):
                grid[: n[k], k] = pieces[i]
            live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
            lanes = np.arange(len(self.langs))[:, None]
            state, ended = None, np.zeros((len(self.langs), len(mine)), dtype=np.int32)
            for step in range(int(n[0])):
                m = live[step]
                if m < ended.shape[1]:
                    out[mine[m : ended.shape[1]]] = ended[:, m:].T
                    state, ended = state[:, :m], ended[:, :m].copy()
                c = self.of[:, grid[step, :m]]
                anew = self.root[lanes, c]
                if state is None:  # nothing ends before the first symbol
                    state = anew
                    continue
                place = self.base[state] + c
                goes = self.owner[place] == state
                ended += ~goes
                state = np.where(goes, self.target[place], anew)
            out[mine[: ended.shape[1]]] = ended.T
        return out + 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, score
        for lo in range(0, len(texts), 2000):
            self._predict(texts, lo, min(len(texts), lo + 2000), names, score)
        return names, score

    def _predict(self, texts, lo, hi, names, score) -> None:
        pieces, of, total = [], [], {}
        for i in range(lo, hi):
            s = self.symbols(texts[i]) if texts[i] else np.zeros(0, dtype=np.int32)
            if (s != SEPARATOR).any():
                total[i] = len(s)
                for k in range(0, len(s), PIECE):
                    pieces.append(s[k : k + PIECE])
                    of.append(i)
        if not pieces:
            return
        ids, inverse = np.unique(of, return_inverse=True)
        count = np.zeros((len(ids), len(self.langs)))
        np.add.at(count, inverse, self.phrases(pieces))
        rate = count * self.bits / np.array([total[i] for i in ids])[:, None]
        best = rate.argmin(1)
        first = rate.min(1)
        rate[np.arange(len(ids)), best] = np.inf
        second = rate.min(1)
        margin = np.where(np.isinf(second), 1.0, 1 - first / second)
        for k, i in enumerate(ids):
            names[i], score[i] = self.langs[best[k]], margin[k]


def labelled_passages(labelled: DataFrame, passages: int, passage_chars: int, *, key: str, text: str, lang: str) -> dict[str, list[str]]:
    """At most ``passages`` passages a language, picked by the hash of key and passage; two steps keep a hot language off one task."""
    h = F.xxhash64(F.col(key), F.substring(text, 1, passage_chars))
    rows = (
        labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER))
        .select(F.col(lang).alias("lang"), h.alias("h"), F.pmod(h, F.lit(64)).alias("b"), F.substring(text, 1, passage_chars).alias("p"))
        .withColumn("r", F.row_number().over(W.partitionBy("lang", "b").orderBy("h", "p")))
        .where(F.col("r") <= max(1, passages // 16))
        .withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "p")))
        .where(F.col("r") <= passages)
        .select("lang", "p")
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["lang"], []).append(r["p"])
    return out


def identify(docs: DataFrame, passages: dict[str, list[str]], *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score (1 - best rate / second-best rate, 0 to 1).

    The automata are built once, of a sample of fixed size a language; tasks get their packed tables.
    """
    sent = docs.sparkSession.sparkContext.broadcast(CrossParser(passages))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = sent.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return added(docs, into, predict(F.col(text)))


def held_out(key):
    """Whether a row is in the fold that nothing is learnt from; a null key is not."""
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def fit_and_identify(docs: DataFrame, *, passages: int = 64, passage_chars: int = 600, key: str = "doc_id", text: str = "text", lang: str = "lang", into: str = "language") -> DataFrame:
    """Learn from the rows outside the held-out fold (crc32(key) mod 4 = 2), then label every row."""
    learn = docs.where(~held_out(F.col(key)))
    return identify(docs, labelled_passages(learn, passages, passage_chars, key=key, text=text, lang=lang), text=text, into=into)


def op6_cross_parsing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fit_and_identify(docs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
