"""Operator 6: BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent pieces (words as the byte-level pre-tokenizer cuts them) are compiled,
sorted, into a minimal deterministic automaton with shared suffixes; the number
of accepted words below every transition gives each word its rank, and the rank
its ids (the output).  The arrays are one flat file which executors receive
through Spark and memory-map.  A batch's distinct pieces walk the automaton
together, one byte a step; pieces outside it are merged exactly by rank.

The lexicon only decides which path a piece takes, never its ids.

Defined cases: null and empty texts give no ids (and the hash of the empty
string); very long texts are read whole; a special token's string in a text is
that token, as the library does by default; a lone surrogate cannot occur in a
Spark string; repeated rows give repeated rows; an empty table gives an empty
result (and an empty lexicon); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import drop, map_batches, open_fs, scratch, store

#: The byte-level pre-tokenizer's pattern.  Fixed value.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LEXICON_WORDS, BATCH_BYTES = 60_000, 16e6
NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in letters])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a * (1 << 24) + b for a, b in self.merge] or [-1])
        rank = np.array([m[0] for m in self.merge.values()] or [NO_RANK])
        order = np.argsort(keys)
        self.pair, self.pair_rank = keys[order], rank[order]
        self.product = np.array([m[1] for m in self.merge.values()] or [0])[np.argsort(rank)]
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.piece = regex.compile(PATTERN)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many pieces, as (ids, ids per piece): in each piece always
        the pair of lowest rank, leftmost first; one merge a round in every piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        got = []                            # (owners, ids) of pieces that are done
        for i in np.flatnonzero(size > 64):
            x = np.array(self.merged_long([int(self.first[b]) for b in pieces[i]]))
            got.append((np.full(len(x), i), x))
        live = np.flatnonzero((size > 0) & (size <= 64))
        sizes = size[live]
        ids = self.first[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:], np.repeat(live, sizes)) if len(live) else ids
        while len(live):
            start = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, start)
            done = low == NO_RANK
            if done.any():
                keep = np.repeat(~done, sizes)
                got.append((np.repeat(live[done], sizes[done]), ids[~keep]))
                ids, rank, live, sizes, low = ids[keep], rank[keep], live[~done], sizes[~done], low[~done]
                if not len(live):
                    break
            owner = np.repeat(np.arange(len(live)), sizes)
            at = np.flatnonzero(rank == low[owner])
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            ids[at] = self.product[low]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, owner, sizes = ids[keep], rank[keep], owner[keep], sizes - 1
            at = at - np.arange(len(at))
            for k in (at, at - 1):
                k = k[(k >= 0) & (k < len(ids))]
                nxt = np.minimum(k + 1, len(ids) - 1)
                rank[k] = np.where((nxt > k) & (owner[k] == owner[nxt]), self.rank_of(ids[k], ids[nxt]), NO_RANK)
        owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in got)])
        flat = np.concatenate([np.zeros(0, np.int64), *(x for _, x in got)])
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(pieces))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * (1 << 24) + b
        i = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[i] == want, self.pair_rank[i], NO_RANK)

    def ranks(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.append(np.where(owner[:-1] == owner[1:], self.rank_of(a, b), NO_RANK), NO_RANK)

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: near linear."""
        from heapq import heapify, heappop, heappush

        n = len(ids)
        after, before, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.merge
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], new))):
                heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: list[bytes], out: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct ``words``, whose ids are ``out``
    (``sizes`` of them per word); arrays only.

    ``edge_of[s]`` is where the edges of state ``s`` start; an edge has a byte, a
    target and the number of accepted words that sort before its branch."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []          # (accepts, ((byte, state), ...))
    path: list[list] = [[False, []]]               # states of the last word, not yet shared

    def share(depth: int) -> None:
        while len(path) - 1 > depth:
            accepts, edges = path.pop()
            key = (accepts, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        share(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    share(0)
    states.append((path[0][0], tuple(path[0][1])))  # the start is the last state
    below = np.zeros(len(states), np.int64)
    edge_of, byte, target, skip = [0], [], [], []
    for s, (accepts, edges) in enumerate(states):   # targets come before their sources
        seen = int(accepts)
        for b, t in edges:
            byte.append(b)
            target.append(t)
            skip.append(seen)
            seen += below[t]
        below[s] = seen
        edge_of.append(len(byte))
    # an edge is found by its key (state, byte): the keys are sorted
    state = np.repeat(np.arange(len(states)), np.diff(edge_of))
    return {"key": state * 256 + np.array(byte, np.int64), "target": np.array(target, np.int64),
            "skip": np.array(skip, np.int64), "accepts": np.array([a for a, _ in states], np.int64),
            "out_at": np.concatenate([[0], np.cumsum(sizes)]), "out": np.asarray(out, np.int64)}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One flat file: a header line with names and lengths, then the arrays."""
    head = json.dumps([[k, len(v)] for k, v in arrays.items()]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(np.ascontiguousarray(v, "<i8").tobytes() for v in arrays.values())


def memory_map(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = f.readline()
    out, at = {}, len(head)
    for name, n in json.loads(head):
        out[name] = np.memmap(path, "<i8", "r", at, (n,)) if n else np.zeros(0, np.int64)
        at += 8 * n
    return out


def look_up(lex: dict[str, np.ndarray], pieces: list[bytes]) -> np.ndarray:
    """The rank of every piece that the automaton accepts, else -1; all pieces
    walk together, one byte a step."""
    n = len(pieces)
    if not n or not len(lex["key"]):
        return np.full(n, -1)
    size = np.array([len(p) for p in pieces])
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces), np.uint8)
    state = np.full(n, len(lex["accepts"]) - 1)
    rank = np.zeros(n, np.int64)
    alive = size > 0
    live = np.flatnonzero(alive)
    step = 0
    key, target, skip = (np.asarray(lex[k]) for k in ("key", "target", "skip"))
    while len(live):
        want = state[live] * 256 + data[at[live] + step]
        e = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[e] == want
        alive[live[~hit]] = False
        live, e = live[hit], e[hit]
        rank[live] += skip[e]
        state[live] = target[e]
        step += 1
        live = live[size[live] > step]
    return np.where(alive & (lex["accepts"][state] > 0), rank, -1)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated runs ``flat[start:start + size]``."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


class Codec:
    """Encoder and decoder of one task: vocabulary and lexicon.

    A text is cut at its blanks into chunks; the pre-tokenizer cuts " chunk" as it
    would inside the text, unless a blank stands inside a run of white space:
    a text where one may (``RUN``, ``WIDE``) is one unit.  Distinct units are cut into pieces,
    distinct pieces are looked up or merged, then ids are gathered back in order."""

    RUN = ("  ", "\n ", "\t ", "\r ", "\v ", "\f ", "\x1c", "\x1d", "\x1e", "\x1f", "\0", "\1")
    WIDE = regex.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")

    def __init__(self, vocabulary: str, lexicon: dict[str, np.ndarray]):
        self.v, self.lex, self.from_lexicon, self.unseen = Vocabulary(vocabulary), lexicon, 0, 0
        size = max(self.v.bytes, default=0) + 1
        self.id_text = pa.array([str(i) for i in range(size)], pa.large_string())
        self.id_bytes = pa.array([self.v.bytes.get(i, b"") for i in range(size)], pa.large_binary())

    def units(self, texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(units, texts in the order of their units, units per text).

        A unit "\\0..." is cut as it is, "\\1..." is a special token, others follow a blank."""
        special = self.v.split_special
        even, odd, rest, rest_size = [], [], [], []
        for i, t in enumerate(texts):
            t = t or ""
            if not ("<|" in t or t[-1:] == " " or any(map(t.__contains__, self.RUN))
                    or not t.isascii() and self.WIDE.search(t)):
                even.append(i)
                continue
            odd.append(i)
            parts = special.split(t) if special else [t]
            units = [("\1" if j % 2 else "\0") + x for j, x in enumerate(parts) if x]
            rest += units
            rest_size.append(len(units))
        cut = pa.compute.split_pattern(pa.array(["\0" + (texts[i] or "") for i in even], pa.large_string()), pattern=" ")
        size = pa.compute.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        return (pa.concat_arrays([cut.flatten().cast(pa.large_string()), pa.array(rest, pa.large_string())]),
                np.array(even + odd, np.int64), np.concatenate([size, np.array(rest_size, np.int64)]))

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of distinct pieces: lexicon first, exact merges for the rest."""
        raw = [p.encode() for p in pieces]
        rank = look_up(self.lex, raw)
        unseen = np.flatnonzero(rank < 0)
        merged, merged_size = self.v.merged([raw[i] for i in unseen])
        self.unseen += len(unseen)
        self.from_lexicon += len(pieces) - len(unseen)
        out = np.asarray(self.lex["out"])
        known = np.maximum(rank, 0)
        size = np.diff(self.lex["out_at"])[known] if len(out) else np.zeros(len(pieces), np.int64)
        start = np.asarray(self.lex["out_at"])[known]
        size[unseen] = merged_size
        start[unseen] = len(out) + np.cumsum(merged_size) - merged_size
        return ragged(np.concatenate([out, merged]), start, size), size

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        from itertools import chain

        units, text_order, n_units = self.units(texts)
        units = units.dictionary_encode()
        find = self.v.piece.findall
        cut = [[" " + u] if u.isalpha() else find(u[1:]) if u[:1] == "\0" else [u] if u[:1] == "\1" else find(" " + u)
               for u in units.dictionary.to_pylist()]
        pieces = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        ids, size = self.piece_ids([p if p[:1] != "\1" or p[1:] not in self.v.special else "" for p in names])
        at = np.cumsum(size) - size
        for i, p in enumerate(names):
            if p[:1] == "\1" and p[1:] in self.v.special:     # one id each, behind the others
                at[i], size[i] = len(ids), 1
                ids = np.append(ids, self.v.special[p[1:]])
        index = pieces.indices.to_numpy()
        n_pieces = np.array([len(c) for c in cut], np.int64)
        flat = ragged(ids, at[index], size[index])            # ids of all distinct units
        unit_size = np.zeros(len(cut), np.int64)
        np.add.at(unit_size, np.repeat(np.arange(len(cut)), n_pieces), size[index])
        unit_at = np.cumsum(unit_size) - unit_size
        u = units.indices.to_numpy()
        by_unit = unit_size[u]
        total = np.concatenate([[0], np.cumsum(by_unit)])
        unit_end = np.cumsum(n_units)
        out_size, out_at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        out_at[text_order] = total[unit_end - n_units]
        out_size[text_order] = total[unit_end] - total[unit_end - n_units]
        return ragged(ragged(flat, unit_at[u], by_unit), out_at, out_size), out_size

    def joined(self, ids: np.ndarray, size: np.ndarray, of: pa.Array, by) -> list:
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int64())
        lists = pa.LargeListArray.from_arrays(offsets, of.take(pa.array(ids)))
        return pa.compute.binary_join(lists, pa.scalar(by, of.type)).to_pylist()

    def id_texts(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        return self.joined(ids, size, self.id_text, ",")

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts that runs of ids stand for."""
        return [b.decode("utf-8", "replace") for b in self.joined(ids, size, self.id_bytes, b"")]


def frequent_pieces(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces over all documents, whatever their batches: each
    batch reports all its pieces with their counts, which are then added up."""
    def run(batches):
        # pieces that follow one blank, the bulk; the rest is merged exactly
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                text = batch.column(0).slice(at, step).cast(pa.large_string())
                seen = pa.compute.value_counts(pa.compute.split_pattern(text, pattern=" ").flatten())
                yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()), seen.field("counts")],
                                                 names=["piece", "n"])

    split = F.explode(F.split("piece", r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"))
    counted = (docs.select("text").mapInArrow(run, "piece string, n long").where("piece <> ''")
               .groupBy("piece").agg(F.sum("n").alias("n")))
    pieces = (counted.select(split.alias("piece"), "n").where(F.length("piece").between(1, 60) & ~F.col("piece").rlike(r"\s"))
              .groupBy("piece").agg(F.sum("n").alias("n")))
    pieces = store(pieces, "pieces")
    # a histogram of counts in steps of about 1 %: no task sends what can't be among the first
    step = F.floor(F.log2("n") * 64)
    left, lowest = words, 0
    for r in sorted(pieces.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["n"]):
        left, lowest = left - r["c"], r["n"]
        if left <= 0:
            break
    got = [r[0] for r in pieces.where(F.col("n") >= lowest).orderBy(F.desc("n"), "piece").limit(words).collect()]
    drop(pieces)
    return got


def publish(spark: SparkSession, vocabulary: str, pieces: list[str]) -> str:
    """Compile the lexicon, write it to the shared folder, hand it to executors; its file name."""
    v = Vocabulary(vocabulary)
    forms = sorted({f.encode() for p in pieces for f in (p, " " + p) if v.piece.findall(f) == [f]})
    blob = pack(compile_lexicon(forms, *v.merged(forms)))
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = f"{scratch(spark, 'lexicon')}/{name}"
    fs, inner = open_fs(path)
    fs.create_dir(os.path.dirname(inner))
    with fs.open_output_stream(inner, compression=None) as f:
        f.write(blob)
    spark.sparkContext.addFile(path)
    return name


def codec(vocabulary: str, lexicon_file: str) -> Codec:
    return Codec(vocabulary, memory_map(SparkFiles.get(lexicon_file)))


def encode_documents(docs: DataFrame, vocabulary: str, lexicon_file: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded text."""
    sc_vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary)    # a fixed-size file

    def fn(cols, c):
        ids, size = c.encode(cols["text"])
        return {"doc_id": cols["doc_id"], "n_tokens": size,
                "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in c.id_texts(ids, size)],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in c.decode(ids, size)]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                       start=lambda: codec(sc_vocabulary.value, lexicon_file), batch_bytes=BATCH_BYTES)


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    return encode_documents(docs, vocabulary, publish(spark, vocabulary, frequent_pieces(docs)))
