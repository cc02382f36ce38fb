"""Offset-preserving SentencePiece encoding and decoding.

The model's compiled character map is parsed into a trie of (prefix -> replacement); normalisation
takes the longest prefix at each position and records, per normalised byte, the source byte range it
came from. Byte-pair merges then run on the normalised text in rank order, cut first at places that
no vocabulary piece can span (so a cached unit always merges alike), and every piece is projected to
its original byte span.

Defined cases: null text counts as empty; empty text has no pieces and decodes to ''; of equally ranked
pairs the first is merged. Extra columns are ignored; repeated rows each get their row; an empty table
gives an empty result. Texts of any length are coded whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import table

SPACE = "▁"
#: Units cached per worker; beyond it the cache starts afresh (a speed matter only).
CACHE_UNITS = 600_000
BATCH_ROWS = 1000
NEVER = float("inf")  # rank of a pair that is no piece


class CharMap:
    """A precompiled character map: a little-endian double-array trie followed by replacement strings."""

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        self.longest = 0
        if len(blob) < 4:
            return
        size = struct.unpack_from("<I", blob)[0]
        units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        pool = blob[4 + size :]
        stack = [(b"", self._base(units, 0, 0))]
        while stack:
            key, base = stack.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at >= len(units) or (units[at] & 0x800000FF) != byte:
                    continue
                nxt = self._base(units, at, at)
                word = key + bytes([byte])
                if units[at] >> 8 & 1:
                    off = units[nxt] & 0x7FFFFFFF
                    self.rules[word] = pool[off : pool.index(b"\0", off)]
                    self.longest = max(self.longest, len(word))
                stack.append((word, nxt))

    @staticmethod
    def _base(units: list[int], at: int, node: int) -> int:
        u = units[node]
        return at ^ ((u >> 10) << ((u & (1 << 9)) >> 6))

    def normalise(self, text: bytes) -> tuple[bytes, list[int], list[int]]:
        """Normalised bytes with, for each of them, the begin and end of its source bytes."""
        out, begin, end, i = bytearray(), [], [], 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (new := self.rules.get(text[i : i + n])) is not None:
                    break
            else:
                lead = text[i]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[i : i + n]
            out += new
            same = new == text[i : i + n]
            for k in range(len(new)):
                begin.append(i + k if same else i)
                end.append(i + k + 1 if same else i + n)
            i += n
        return bytes(out), begin, end


class Codec:
    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with white space as a prefix is needed")
        spec = m.normalizer_spec
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        self.rank, self.byte_id, self.out = {}, {}, []
        self.unk = 0
        self.control = set()
        for i, p in enumerate(m.pieces):
            self.out.append(p.piece.replace(SPACE, " ").encode())
            if p.type == 1:
                self.rank[p.piece] = (-p.score, i)
            elif p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b] = i
                self.out[-1] = bytes([b])
            elif p.type == 2:
                self.unk = i
                self.out[-1] = " ⁇ ".encode()
            elif p.type == 3:
                self.control.add(i)
                self.out[-1] = b""
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        self.bytes_ids = set(self.byte_id.values())
        # A unit ends before a space mark that follows another character, unless a piece spans the two;
        # a character that is in no longer piece stands alone.
        joined = [p for p in self.rank if len(p) > 1]
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joined)
        merging = "".join(sorted({c for p in joined for c in p}))
        cls = re.escape(merging.replace(SPACE, ""))
        self.unit = re.compile(f"[{cls}{SPACE}]+|[^{cls}{SPACE}]") if inner else re.compile(f"{SPACE}+[{cls}]*|[{cls}]+|[^{cls}{SPACE}]")
        self.cache: dict[str, tuple] = {}
        self.width = np.array([len(o) for o in self.out], np.int64)
        self.order = {p: o for p, (o, _) in self.rank.items()}

    def merge(self, unit: str) -> tuple:
        """(ids, byte lengths in the normalised text) of a unit that nothing outside can merge with."""
        parts, rank = list(unit), self.rank
        if len(parts) > 400:
            parts = self._merge_long(parts)
        else:
            # The first of the best pairs is merged, and the pairs beside it are looked up again.
            get = self.order.get
            best = [get(a + b, NEVER) for a, b in pairwise(parts)]
            while best and (top := min(best)) < NEVER:
                i = best.index(top)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del best[i]
                if i < len(best):
                    best[i] = get(parts[i] + parts[i + 1], NEVER)
                if i:
                    best[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        ids, lens = [], []
        for p in parts:
            hit = rank.get(p)
            raw = p.encode()
            if hit is not None:
                ids.append(hit[1])
                lens.append(len(raw))
            elif self.byte_id:
                ids += [self.byte_id[b] for b in raw]
                lens += [1] * len(raw)
            else:
                ids.append(self.unk)
                lens.append(len(raw))
        return ids, lens

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges by a heap over linked symbols: n log n, for units of any length."""
        import heapq

        n, rank = len(parts), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (r := rank.get(parts[i] + parts[j])) is not None:
                heap.append((r[0], i, parts[i], parts[j])) if not ready else heapq.heappush(heap, (r[0], i, parts[i], parts[j]))

        ready = False
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b or not a:
                continue
            parts[i], parts[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [p for p in parts if p]

    def normalise(self, text: str) -> tuple[str, list[int] | None, list[int] | None]:
        """Normalised text and source alignment; the alignment is None where it is the identity after the prefix."""
        begin = end = None
        if self.map.rules:
            raw, begin, end = self.map.normalise(text.encode())
            text = raw.decode()
        if self.squeeze:
            if begin is None:
                n = len(text.encode())
                begin, end = list(range(n)), list(range(1, n + 1))
            keep, at = [], 0
            last = True
            for ch in text:
                w = len(ch.encode())
                if not (ch == " " and last):
                    keep.append((ch, at, w))
                last = ch == " "
                at += w
            while keep and keep[-1][0] == " ":
                keep.pop()
            begin = [begin[a + k] for _, a, w in keep for k in range(w)]
            end = [end[a + k] for _, a, w in keep for k in range(w)]
            text = "".join(c for c, _, _ in keep)
        if not text:
            return "", begin, end
        if self.dummy:
            text = " " + text
        return (text.replace(" ", SPACE) if self.escape else text), begin, end

    def learn(self, units) -> None:
        """Put the units that the cache lacks into it, as packed ids."""
        cache = self.cache
        if len(cache) >= CACHE_UNITS:
            cache.clear()
        new = list({u for u in units if u not in cache})
        gc.disable()  # millions of fresh ints and lists, none in a cycle
        coded = [self.merge(u)[0] for u in new]
        gc.enable()
        flat = np.fromiter(chain.from_iterable(coded), np.int32).tobytes()
        at = 0
        for u, ids in zip(new, coded):
            cache[u] = flat[at : (at := at + 4 * len(ids))]

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """ids, and the begin and end of each piece in the source's UTF-8 bytes."""
        norm, begin, end = self.normalise(text)
        units = self.unit.findall(norm)
        self.learn(units)
        ids, begins, ends = self.assemble(text, norm, units, begin, end)
        return ids.tolist(), begins, ends

    def assemble(self, text, norm, units, begin, end):
        """Pieces of units that the cache holds: ids, begins and ends in source bytes."""
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, units)), np.int32)
        if self.byte_id:
            lens = self.width[ids]
        else:
            lens = np.array([n for u in units for n in self._source_lengths(u, self.merge(u)[1])], np.int64)
        ends = np.cumsum(lens)
        begins = ends - lens
        if self.dummy and len(ids):
            ends, begins = np.maximum(ends - 1, 0), np.maximum(begins - 1, 0)
        if self.escape and SPACE in text:
            self.literal = text
            begins, ends = self._literal_marks(norm, units)
        if begin is not None and len(ids):
            b, e = np.array([*begin, begin[-1] + 1 if begin else 0]), np.array([0, *accumulate(end, max)])
            begins, ends = b[np.minimum(begins, len(b) - 1)], e[np.minimum(ends, len(e) - 1)]
        return ids, begins, ends

    def encode_all(self, texts: list[str]) -> list[tuple]:
        """``assemble`` for many texts; the merges of all their new units are one call."""
        norms = [self.normalise(t) for t in texts]
        units = [self.unit.findall(n[0]) for n in norms]
        self.learn(chain.from_iterable(units))
        return [self.assemble(t, n[0], u, n[1], n[2]) for t, n, u in zip(texts, norms, units)]

    def _source_lengths(self, unit: str, lens: list[int]) -> list[int]:
        raw, out, at = unit.encode(), [], 0
        for n in lens:
            out.append(n - 2 * raw[at : at + n].count(SPACE.encode()))
            at += n
        return out

    def _literal_marks(self, norm, units):
        """Spans where the text itself holds the space mark (three bytes): counted through the normalised text."""
        text = self.literal
        size = [len(c.encode()) for c in text]
        if self.dummy:
            size.insert(0, 0)
        per_byte = [0]
        for c, s in zip(norm, size):
            per_byte += [per_byte[-1]] * (len(c.encode()) - 1) + [per_byte[-1] + s]
        at, b, e = 0, [], []
        lens = [n for u in units for n in self.merge(u)[1]]
        for n in lens:
            b.append(per_byte[at])
            at += n
            e.append(per_byte[at])
        return np.array(b, np.int64), np.array(e, np.int64)

    def decode(self, ids: list[int]) -> str:
        out = self.out
        raw = b"".join([out[i] for i in ids])
        text = raw.decode("utf-8", "replace")
        if self.dummy and ids:
            first = next((i for i in ids if i not in self.control), None)
            if first is not None and first not in self.bytes_ids and text.startswith(" "):
                text = text[1:]
        return text


def coder(model_path: str, digests: bool = False):
    """The worker side of ``encode_frame``: Arrow batches of (id, text) to pieces with spans."""

    def run(batches):
        codec = Codec(model_path)
        decimal = [str(i) for i in range(len(codec.out))]
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                ids, begins, ends, sizes, decoded, hashes = [], [], [], [0], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, b, e in codec.encode_all(texts):
                    numbers = i.tolist()
                    sizes.append(sizes[-1] + len(i))
                    decoded.append(codec.decode(numbers))
                    if digests:
                        spans = hashlib.sha256(b.tobytes() + e.tobytes())
                        hashes.append([h.hexdigest() for h in (hashlib.sha256(",".join([decimal[x] for x in numbers]).encode()), hashlib.sha256(decoded[-1].encode()), spans)])
                    else:
                        ids.append(i)
                        begins.append(b)
                        ends.append(e)
                if digests:
                    cols = [part.column(0), pa.array(np.diff(sizes), pa.int64()), *[pa.array([h[k] for h in hashes], pa.string()) for k in range(3)]]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
                    continue
                off = pa.array(sizes, pa.int32())
                cat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), kind)
                cols = [part.column(0), pa.ListArray.from_arrays(off, cat(ids, pa.int32())), pa.ListArray.from_arrays(off, cat(begins, pa.int64())), pa.ListArray.from_arrays(off, cat(ends, pa.int64())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "begins", "ends", "decoded"])

    return run


def encode_frame(df: DataFrame, model_path: str, key: str, text: str) -> DataFrame:
    """(key, ids, begins, ends, decoded): pieces of each whole text, source byte spans, and the round trip."""
    kind = df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = d.mapInArrow(coder(model_path), f"id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")
    return out.withColumnRenamed("id", key)


def encode_digests(df: DataFrame, model_path: str, key: str, text: str) -> DataFrame:
    """As ``encode_frame``, with the digests of ids, text and spans taken beside the pieces, so that pieces are not shipped."""
    kind = df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = d.mapInArrow(coder(model_path, True), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return out.withColumnRenamed("id", key)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), model_path(), "doc_id", "text")
