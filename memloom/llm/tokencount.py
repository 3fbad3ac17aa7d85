"""Token counts: the exact count of every prefix of a text, by dynamic programming over prefixes.

For a byte-pair encoding, a prefix has exactly one last token: the one token ``t`` that ends there and may stand behind
the last token of the prefix before it (the pair encodes to itself).  So the count of a prefix is the count of that
shorter prefix plus one, and one pass over the bytes gives the counts of all prefixes.  Stored once, as one signed byte
a code point (the change of the count), they answer questions of truncation and budget without encoding anything again:
``count_at``, ``longest_prefix``, ``truncated``, ``within_budget``.

The tokenizer parts a text before merging, and a prefix can be parted otherwise than the same signs inside the whole
text.  Units (a run of white space with the signs behind it) are encoded independently, and within a unit three
places differ: the end of a run of white space (one part at the end of a prefix; else its last blank goes to the next
part), unfinished contractions (``'l`` is two parts, ``'ll`` one), and an unfinished added token, which is ordinary text
until its last sign.

Defined cases: null is the empty text: no bytes, no tokens, no steps; repeated rows are counted one by one; empty tables
give no rows; texts are read whole; other columns are kept as they are, and a table that has a column named like ``into``
is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, running, table

#: White space as the tokenizer's own pattern has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
RUN = re.compile(f"[{SPACE}]*")
BEGIN = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: Most units are at most one blank, letters, and marks: they are parted without the tokenizer.
WORD = re.compile("( ?[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]+)([!-/:-@\\[-`{-~]*)")
#: Contractions of three signs, one part each; unfinished, they are two.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Code points looked at together; longer texts are cut where units begin.
CHUNK = 1_000_000
#: Units of at most so many signs are remembered, so many in each of two generations.
SIGNS, KNOWN = 48, 200_000
#: Parts of at most so many bytes are worked through side by side, longer ones alone.
SHORT = 48
#: Slots for what is known of pairs of tokens (2 to this power).
PAIRS = 20
SCHEMA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("steps", T.BinaryType())])
_COUNTERS: dict = {}


class PrefixCounter:
    """Counts of all prefixes for a byte-level BPE tokenizer of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.model, self.parts = tok.model, tok.pre_tokenizer.pre_tokenize_str
        extra = tok.get_added_tokens_decoder().values()
        if tok.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in extra):
            raise ValueError("only tokenizers without a normaliser whose added tokens stand anywhere are counted")
        self.extra = re.compile("|".join(re.escape(t) for t in sorted((t.content for t in extra), key=len, reverse=True)) or r"(?!)")
        vocab = tok.get_vocab(with_added_tokens=False)
        self.size = max(vocab.values()) + 1
        self.sign = {b: s for s in (t for t in vocab if len(t) == 1) for b in self._raw(s)}
        raw = {bytes(map({s: b for b, s in self.sign.items()}.__getitem__, t)): i for t, i in vocab.items()}
        # The tokens as a trie: from a node and a byte to the next node (0: none), and the token that a node is (-1: none).
        nodes = {b"": 1}
        for t in raw:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes) + 1)
        self.next = np.zeros((len(nodes) + 1, 256), dtype=np.int32)
        self.token = np.full(len(nodes) + 1, -1, dtype=np.int64)
        for t, k in nodes.items():
            if t:
                self.next[nodes[t[:-1]], t[-1]] = k
                self.token[k] = raw.get(t, -1)
        self.keys, self.stand = np.full(1 << PAIRS, -1, dtype=np.int64), np.zeros(1 << PAIRS, dtype=bool)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _raw(sign: str) -> bytes:
        """The byte that a sign of the byte-level alphabet stands for: printable signs for themselves, others numbered from 256 on."""
        rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        return bytes([rest[ord(sign) - 256] if ord(sign) > 255 else ord(sign)])

    def stands(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the second token may follow the first (pairs are first * size + second): their joint bytes encode to the two."""
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)
        out = self.stand[slot]
        if len(miss := np.flatnonzero(self.keys[slot] != pairs)):
            asked, back = np.unique(pairs[miss], return_inverse=True)
            got = np.empty(len(asked), dtype=bool)
            for i, pair in enumerate(asked.tolist()):
                a, b = divmod(pair, self.size)
                both = self.model.tokenize(self.model.id_to_token(a) + self.model.id_to_token(b))
                got[i] = len(both) == 2 and both[0].id == a
            out[miss] = got[back]
            # Slots are overwritten one pair at a time: key and answer belong together.
            last = dict(zip(slot[miss].tolist(), range(len(miss))))
            where, which = np.fromiter(last, dtype=np.int64), np.fromiter(last.values(), dtype=np.int64)
            self.keys[where], self.stand[where] = pairs[miss][which], out[miss][which]
        return out

    def counts(self, parts: list[bytes]) -> np.ndarray:
        """Counts of the prefixes of all parts, byte by byte, laid end to end.  Parts advance side by side, a byte a round."""
        data, sizes = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts])
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = np.repeat(np.cumsum(sizes), sizes)
        # Every token that occurs: where it starts, and where it ends.
        at = np.arange(len(data))
        node, n, starts, ends, tokens = np.ones(len(data), dtype=np.int32), 0, [], [], []
        while len(at):
            node = self.next[node, data[at + n]]
            hit = self.token[node] >= 0
            starts.append(at[hit])
            ends.append(at[hit] + n)
            tokens.append(self.token[node[hit]])
            n += 1
            on = (node > 0) & (at + n < stop[at])
            at, node = at[on], node[on]
        start, end, token = map(np.concatenate, (starts, ends, tokens))
        round_ = end - begin[end]
        order = np.argsort(round_, kind="stable")
        start, end, token = start[order], end[order], token[order]
        edges = np.searchsorted(round_[order], np.arange(sizes.max() + 1))
        last, count = np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=np.int32)
        for lo, hi in zip(edges, edges[1:]):
            s, e, t = start[lo:hi], end[lo:hi], token[lo:hi]
            whole = s == begin[s]
            before = np.where(whole, 0, s - 1)
            good = whole | self.stands(np.where(whole, 0, last[before]) * self.size + t)
            s, e, t, whole, before = s[good], e[good], t[good], whole[good], before[good]
            last[e], count[e] = t, np.where(whole, 0, count[before]) + 1
        return count

    def long_counts(self, part: bytes) -> np.ndarray:
        """The same for one long part."""
        following, token, size, known = self.next, self.token, self.size, {}
        last, count, open_ = [-1], [0], []
        for i, byte in enumerate(part):
            # Nodes of all tokens that are under way, the longest first.
            open_ = [(s, k) for s, k in ((s, int(following[k, byte])) for s, k in [*open_, (i, 1)]) if k]
            for s, k in open_:
                if (t := int(token[k])) < 0:
                    continue
                if s and (pair := last[s] * size + t) not in known:
                    known[pair] = bool(self.stands(np.array([pair]))[0])
                if not s or known[pair]:
                    last.append(t)
                    count.append(count[s] + 1)
                    break
        return np.array(count[1:], dtype=np.int32)

    def changes(self, parts: set[str]) -> dict[str, bytes]:
        """For each part, how its count changes with each code point."""
        listed = [(p, p.encode()) for p in parts]
        out = {}
        for mine in ([x for x in listed if len(x[1]) <= SHORT], *([x] for x in listed if len(x[1]) > SHORT)):
            if not mine:
                continue
            raw = [b for _, b in mine]
            count = self.counts(raw) if len(raw[0]) <= SHORT else self.long_counts(raw[0])
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            closes = np.append((data[1:] & 0xC0) != 0x80, True)
            first = np.zeros(len(data), dtype=bool)
            first[np.cumsum([0] + [len(b) for b in raw[:-1]])] = True
            opens = np.append(True, closes[:-1])
            count, first = count[closes], first[opens]
            steps = count - np.where(first, 0, np.append(0, count[:-1]))
            if steps.max() > 127 or steps.min() < -128:
                raise OverflowError("a count changes by more than a byte holds")
            buffer, lo = steps.astype(np.int8).tobytes(), 0
            for p, _ in mine:
                out[p] = buffer[lo : lo + len(p)]
                lo += len(p)
        return out

    def parted(self, unit: str) -> list[str]:
        if m := WORD.fullmatch(unit):
            return [m[1], m[2]] if m[2] else [m[1]]
        return [unit[a:b] for _, (a, b) in self.parts(unit)]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        parted = [(u, self.parted(u), len(RUN.match(u)[0])) for u in units]
        runs = {u[:k] for u, _, k in parted if 1 < k < len(u)}
        known = self.changes({p for _, ps, _ in parted for p in ps} | runs)
        for p in CONTRACTIONS:
            if p in known:
                known[p] = bytes([1, 1, (total(known[p]) - 2) & 255])
        out = {}
        for u, ps, k in parted:
            steps = b"".join([known[p] for p in ps])
            if 1 < k < len(u):
                # At its end the run of white space is one part; before the next sign, its last blank is the next part's.
                run = known[u[:k]]
                steps = run + bytes([(total(steps[: k + 1]) - total(run)) & 255]) + steps[k + 1 :]
            out[u] = steps
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Steps of texts without added tokens, at most some chunk long."""
        lists = [UNIT.findall(t) for t in texts]
        if len(self.new) > KNOWN:
            self.old, self.new = self.new, {}
        unseen = []
        for u in set().union(*lists).difference(self.new):
            if u in self.old:
                self.new[u] = self.old[u]
            else:
                unseen.append(u)
        self.new |= self.learn(unseen)
        get = self.new.__getitem__
        out = [b"".join(map(get, units)) for units in lists]
        for u in unseen:
            if len(u) > SIGNS:
                del self.new[u]
        return out

    def _sliced(self, text: str) -> bytes:
        """Steps of a text of any length without added tokens."""
        out, at = [], 0
        while at < len(text):
            m = BEGIN.search(text, at + CHUNK)
            to = m.start() if m else len(text)
            out += self._plain([text[at:to]])
            at = to
        return b"".join(out)

    def _marked(self, text: str) -> bytes:
        """Steps of a text that may hold added tokens: until its last sign, each is ordinary text behind what stands before."""
        out, at = [], 0
        for m in self.extra.finditer(text):
            open_ = self._sliced(text[at : m.end() - 1])
            out += [open_, bytes([(1 - total(open_[m.start() - at :])) & 255])]
            at = m.end()
        return b"".join([*out, self._sliced(text[at:])])

    def steps(self, texts: list[str]) -> Iterator[bytes]:
        """For each text, signed bytes, one a code point: how the count changes with it."""
        held: list[str] = []
        size = 0
        for t in [*texts, None]:
            alone = t is None or len(t) > CHUNK or self.extra.search(t)
            if held and (alone or size + len(t) > CHUNK):
                yield from self._plain(held)
                held, size = [], 0
            if t is None:
                return
            if alone:
                yield self._marked(t)
            else:
                held.append(t)
                size += len(t)


def total(steps: bytes) -> int:
    return int(np.frombuffer(steps, dtype=np.int8).sum(dtype=np.int64))


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def counted(docs: DataFrame, tokenizer_path: str, *, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes, n_tokens, and ``steps``, from which the count of every prefix follows."""

    @F.pandas_udf(SCHEMA)
    def count(texts: pd.Series) -> pd.DataFrame:
        whole = texts.fillna("").tolist()
        rows = [(len(t.encode()), total(steps), steps) for t, steps in zip(whole, counter(tokenizer_path).steps(whole))]
        return pd.DataFrame(rows, columns=SCHEMA.names)

    return added(docs, into, count(F.col(text)))


@F.pandas_udf(T.LongType())
def _count_at(steps: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([total(s[: max(int(n), 0)]) for s, n in zip(steps, chars)])


@F.pandas_udf(T.LongType())
def _longest(steps: pd.Series, budget: pd.Series) -> pd.Series:
    def one(s: bytes, n: int) -> int:
        fits = np.flatnonzero(np.cumsum(np.frombuffer(s, dtype=np.int8), dtype=np.int64) <= n)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([one(s, n) for s, n in zip(steps, budget)])


def _number(n: Column | int) -> Column:
    return F.coalesce(n if isinstance(n, Column) else F.lit(n), F.lit(0)).cast("long")


def count_at(steps: Column, chars: Column | int) -> Column:
    """Tokens of the prefix of ``chars`` code points (all of it where the text is shorter; null and less than none: 0)."""
    return _count_at(steps, _number(chars))


def longest_prefix(steps: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens.  A longer prefix can have fewer tokens: the last that fits counts."""
    return _longest(steps, _number(budget))


def truncated(docs: DataFrame, budget: Column | int, *, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` of ``counted`` with each text cut to its longest prefix of at most ``budget`` tokens; a null text stays null."""
    return docs.withColumn(text, F.substr(F.col(text), F.lit(1), longest_prefix(F.col(tokens)["steps"], budget).cast("int")))


def within_budget(docs: DataFrame, budget: int, *, key: str = "doc_id", tokens: str = "tokens", part: str | None = None) -> DataFrame:
    """(key, n_tokens, before, fits): documents in order of the key (of each ``part``) that fit in a joint budget, and the tokens before each.

    Prefix sums by range, so that a part of any size is summed by many tasks.  Null keys come first; rows of one key stand in any order.
    """
    own = docs.select(F.col(part) if part else F.lit(0).alias("all"), F.col(key), F.col(tokens)["n_tokens"].alias("n_tokens"))
    summed = running(own, [part or "all"], [key], before="n_tokens")
    out = summed.withColumn("fits", F.col("before") + F.col("n_tokens") <= budget).drop("place")
    return out if part else out.drop("all")


def op13_prefix_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = counted(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 512).alias("over_limit"))
