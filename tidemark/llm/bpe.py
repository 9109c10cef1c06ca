"""BPE encoding and decoding through a deterministic tokenization automaton.

The merges are compiled by successive merge gadgets.  The automaton starts with the byte tokens, one
state per token ("the token just read") and every arc present.  The gadget of a merge (u, v) -> w, in
the order of the merge list, adds the state w: an arc into w from each state that has an arc to u, the
arcs that leave v as the arcs that leave w, and it removes the arc from u to v.  For u = v the leftmost
pair wins, so u itself gets no arc to w.  What remains accepts exactly the token sequences that BPE
yields, so a pre-split word has one accepting path and each of its prefixes too.

All states and arcs of 50,000 merges would be 2.5e9 bits.  ``Automaton.arc`` therefore answers from the
gadgets that touched the arc, newest first, and keeps the answer: the transition table holds the arcs
that words have met, which is the determinisation on demand of the same automaton.

Words are split as the byte-level pre-tokenizer splits them; a special token's string in the text is
that one token.  Null text is empty text: no ids.  Decoding emits the arc labels (the tokens' bytes) as
UTF-8, with U+FFFD for ill-formed bytes.  Repeated rows are encoded each; other columns pass unchanged.
"""

from __future__ import annotations

import json
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_bounds, distinct_name, read

#: A worker's memory of words, in two generations of so many: what was not met since the last change is forgotten.
MAX_WORDS = 200_000
MAX_ARCS = 500_000


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tokens, merge gadgets and the transition table made from them."""

    def __init__(self, spec: dict, pattern: str):
        vocab = spec["model"]["vocab"]
        self.label = labels(spec)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = regex.compile(pattern)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.born = {i: -1 for i in vocab.values() if len(self.label[i]) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.born[w], self.halves[w], self.merged[u, v] = k, (u, v), k
        # The byte trie of the tokens: node * 256 + byte -> node, and the token that ends at a node.
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i in self.born:
            node = 0
            for b in self.label[i]:
                nxt = self.trie.get(node << 8 | b)
                if nxt is None:
                    nxt = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.arcs: dict[int, bool] = {}
        self.words = _Memory(self)

    def gadget(self, p: int, y: int, before: int) -> bool:
        """Whether the automaton of the first ``before`` merges has the arc from state p to y."""
        while True:
            if self.merged.get((p, y), before) < before:
                return False
            made_p, made_y = self.born[p], self.born[y]
            if made_p < 0 and made_y < 0:
                return True
            if made_p > made_y:
                p, before = self.halves[p][1], made_p
            elif made_y > made_p:
                u, v = self.halves[y]
                if u == v == p:
                    return False
                y, before = u, made_y
            else:
                u, v = self.halves[p]
                p, y, before = v, u, made_p

    def path(self, word: bytes) -> list[int]:
        """The ids of the one accepting path of a pre-split word.

        Arcs are followed from the start, the longest token first.  As a prefix has one path only, a place from which
        no arc leads on lies on no accepting path and is not tried again.
        """
        n = len(word)
        trie, ends, arcs, everything = self.trie, self.ends, self.arcs, len(self.merged)
        out, opened, closed = [], [], set()
        at, state, choices = 0, -1, None
        while at < n:
            if choices is None:
                choices, node = [], 0
                for e in range(at, n):
                    node = trie.get(node << 8 | word[e])
                    if node is None:
                        break
                    if ends[node] >= 0:
                        choices.append((ends[node], e + 1))
            while choices:
                y, e = choices.pop()
                if e in closed:
                    continue
                if state >= 0:
                    key = state << 32 | y
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) >= MAX_ARCS:
                            arcs.clear()
                        ok = arcs[key] = self.gadget(state, y, everything)
                    if not ok:
                        continue
                out.append(y)
                opened.append((at, state, choices))
                at, state, choices = e, y, None
                break
            else:
                closed.add(at)
                out.pop()
                at, state, choices = opened.pop()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as int32."""
        if not text:
            return np.empty(0, np.int32)
        known = self.words.__getitem__
        if not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(known, self.split.findall(text))), np.int32)
        parts = []
        for piece in self.at_special.split(text):
            if piece in self.special:
                parts.append(np.int32(self.special[piece]).tobytes())
            elif piece:
                parts.extend(map(known, self.split.findall(piece)))
        return np.frombuffer(b"".join(parts), np.int32)

    def rest(self) -> None:
        """Forget words and arcs met: a worker is reused, by other operators too."""
        self.words.older = {}
        self.words.clear()
        self.arcs.clear()

    def decode(self, ids) -> str:
        """The arc labels of the ids, joined."""
        return emit(self.label, ids)


def emit(label: dict[int, bytes], ids) -> str:
    return b"".join(map(label.__getitem__, ids)).decode("utf-8", "replace")


def labels(spec: dict) -> dict[int, bytes]:
    """The bytes of each token, special ones included; all that decoding needs."""
    alphabet = _byte_of_char()
    plain = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return plain | {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}


class _Memory(dict):
    """Word -> its path's ids as int32 bytes."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            path = self.automaton.path(word.encode("utf-8", "surrogatepass"))
            out = pack(f"{len(path)}i", *path)
        self[word] = out
        return out


@lru_cache(maxsize=2)
def _compiled(spec: str, pattern: str) -> Automaton:
    return Automaton(json.loads(spec), pattern)


@lru_cache(maxsize=2)
def _labels(spec: str) -> dict[int, bytes]:
    return labels(json.loads(spec))


@lru_cache(maxsize=4)
def load(path: str) -> tuple[str, str]:
    """Read on the driver; executors get the text of the file, not its path."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        return f.read(), public_tokenizers.PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def automaton(path: str | None = None) -> Automaton:
    """The compiled automaton in this process."""
    return _compiled(*load(path or default_path()))


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None, keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``df`` with an array<int> column of the ids of the whole text (name made distinct if taken).

    ``decoded`` names a further column with the text that the ids decode to, made in the same pass: a worker
    of its own for decoding would hold the labels a second time.
    """
    spark = df.sparkSession
    arrow_bounds(spark)
    spec = spark.sparkContext.broadcast(load(path or default_path()))  # a vocabulary file, 1.5 MB
    kept = [c for c in df.columns if keep_text or c != text]
    ids = distinct_name(kept, ids)
    fields = [*(df.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded is not None:
        fields.append(T.StructField(distinct_name([*kept, ids], decoded), T.StringType(), False))
    names = [f.name for f in fields]

    def run(batches):
        machine = _compiled(*spec.value)
        for batch in batches:
            got = [machine.encode(t) for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
            values = np.concatenate(got) if got else np.empty(0, np.int32)
            made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
            if decoded is not None:
                made.append(pa.array([emit(machine.label, g.tolist()) for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), *made], names=names)
        machine.rest()

    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with a string column decoded from the ids; a null list decodes to the empty string."""
    spark = df.sparkSession
    arrow_bounds(spark)
    spec = spark.sparkContext.broadcast(load(path or default_path()))
    text = distinct_name(df.columns, text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches):
        label = _labels(spec.value[0])
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids))
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            out = [emit(label, flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Each whole text encoded and decoded; the digests are taken from the ids and the decoded text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, keep_text=False, decoded="decoded")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_bpe": op3_bpe}
SQL: dict[str, str] = {}
