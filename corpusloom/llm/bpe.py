"""Byte-level BPE as a bounded-lookahead streaming transducer, and the matching incremental decoder.

Encoding reads a text block by block. Splitting into words keeps only the unfinished word; merging keeps only a
window of bytes. `MergeTable.lookahead` is the merge list's sufficient lookahead: a token that ends at least so many
bytes before the end of what has been read cannot change, whatever follows, so it is emitted and forgotten. The
working memory is a block, a window and a word cache of bounded size, for texts of any length.

Why the lookahead suffices. Two inputs share a prefix. Where their merges differ first, some merge (u, v) happened in
only one of them, its boundary u|v lying in the shared part. In the other input v was not there, so some token on the
right edge of v's derivation had been merged with what follows by an earlier rule, or the inputs differ within v
itself. That earlier rule's boundary is v's right end and it happened in one input only, so the argument repeats with
a smaller rank. Hence L(u, v) = |v| + max L(rule), over rules whose left part lies on v's right edge and whose rank is
below that of the merge that consumes this part; the maximum over all rules is the lookahead.

Defined results: a null text counts as empty, an empty text has no tokens (both digests are those of no bytes);
repeated rows give repeated results; an empty table gives an empty table; further columns pass through, but those named
like an output column are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import table, without

BLOCK = 1 << 15
#: Words that a task remembers (twice as many at most) and the longest of them: some 25 MB.
CACHE_WORDS, CACHE_CHARS = 60_000, 48
SPACE = r"\p{White_Space}"
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!{'[^' + SPACE + ']'})|{SPACE}+"
)
RUNS = {
    "letter": regex.compile(r"\p{L}*"),
    "number": regex.compile(r"\p{N}*"),
    "space": regex.compile(rf"{SPACE}*"),
    "other": regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]*"),
}
#: A word that ends this many characters before the end of what is read is final: the longest contraction has three.
HELD = 4
#: Windows up to this many bytes take the plain loop over all pairs, longer ones the heap.
SHORT, NEVER = 32, 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_spec(spec: dict) -> None:
    """Raises unless the file asks for what this module does: byte-level words by the one fixed pattern, plain merges."""
    model, words, decoder = (spec.get(k) or {} for k in ("model", "pre_tokenizer", "decoder"))
    wrong = []
    if spec.get("normalizer"):
        wrong.append("a normalizer")
    if (words.get("type"), words.get("add_prefix_space"), words.get("use_regex", True)) != ("ByteLevel", False, True):
        wrong.append(f"pre-tokenizer {words}")
    if decoder.get("type") != "ByteLevel":
        wrong.append(f"decoder {decoder}")
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"model {model.get('type')}")
    wrong += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    for token in spec.get("added_tokens", []):
        wrong += [f"{k} of {token['content']!r}" for k in ("single_word", "lstrip", "rstrip", "normalized") if token.get(k)]
    if wrong:
        raise ValueError(f"not a plain byte-level tokenizer: {', '.join(wrong)}")


class MergeTable:
    """The vocabulary, the merges by rank and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        as_byte = _byte_of_char()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.specials = specials
        size = max([*vocab.values(), *specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            if text not in specials:
                self.bytes[i] = bytes(as_byte[c] for c in text)
        for text, i in specials.items():
            self.bytes[i] = text.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(as_byte.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rules = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
        self.rank = {(u, v): rank for rank, (u, v, _) in enumerate(self.rules)}
        self.made = [made for _, _, made in self.rules]
        self.lookahead = self._lookahead()
        del self.rules

    def _lookahead(self) -> int:
        made_by: dict[int, int] = {}
        for rank, (_, _, made) in enumerate(self.rules):
            made_by.setdefault(made, rank)
        ranks: dict[int, list[int]] = {}
        best: dict[int, list[int]] = {}
        most = 1
        for rank, (u, v, _) in enumerate(self.rules):
            reach, part, limit = 0, v, rank
            while True:
                k = bisect_left(ranks.get(part, ()), limit)
                if k:
                    reach = max(reach, best[part][k - 1])
                by = made_by.get(part)
                if by is None or by >= limit:
                    break
                part, limit = self.rules[by][1], by
            own = len(self.bytes[v]) + reach
            ranks.setdefault(u, []).append(rank)
            so_far = best.setdefault(u, [])
            so_far.append(max(own, so_far[-1]) if so_far else own)
            most = max(most, own)
        return most

    def tokens(self, data: bytes) -> list[int]:
        """The merges applied to a window, lowest rank first and leftmost among equals."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        get, made = self.rank.get, self.made
        if n <= SHORT:
            ranks = [get(x, NEVER) for x in zip(ids, ids[1:])]
            while ranks:
                low = min(ranks)
                if low == NEVER:
                    break
                i = ranks.index(low)
                ids[i] = new = made[low]
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get((new, ids[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = get((ids[i - 1], new), NEVER)
            return ids
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (rank := get((ids[i], ids[i + 1]))) is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, u, v = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != u or j >= n or ids[j] != v:
                continue
            new = made[rank]
            ids[i], ids[j], k = new, -1, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (rank := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i, new, ids[k]))
            h = prv[i]
            if h >= 0 and (rank := get((ids[h], new))) is not None:
                heapq.heappush(heap, (rank, h, ids[h], new))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=1)
def merge_table(path: str) -> MergeTable:
    """The one table that a process keeps between tasks; its size follows from the vocabulary."""
    return MergeTable(path)


class WordTransducer:
    """The tokens of one word whose bytes arrive in parts; `push` returns those that no further byte can change."""

    def __init__(self, rules: MergeTable):
        self.rules, self.held = rules, b""
        self.window = max(4 * rules.lookahead, 1024)

    def push(self, data: bytes, last: bool) -> list[int]:
        out: list[int] = []
        at, step = 0, self.window
        while True:
            take = data[at : at + max(1, step - len(self.held))]
            at += len(take)
            self.held += take
            ended = last and at >= len(data)
            if not ended and len(self.held) < step:
                return out
            ids = self.rules.tokens(self.held)
            if ended:
                self.held = b""
                return out + ids
            done, size, stable = 0, 0, len(self.held) - self.rules.lookahead
            for i in ids:
                if size + len(self.rules.bytes[i]) > stable:
                    break
                size += len(self.rules.bytes[i])
                done += 1
            out += ids[:done]
            self.held = self.held[size:]
            if at >= len(data) and len(self.held) < step:
                return out


class _Words(dict):
    """Words to their ids as little-endian bytes: a generation of CACHE_WORDS, and the one before it."""

    def __init__(self, rules: MergeTable):
        super().__init__()
        self.rules, self.old = rules, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            data = word.encode()
            ids = self.rules.tokens(data) if len(data) <= SHORT else WordTransducer(self.rules).push(data, True)
            out = pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Encodes texts that arrive in blocks; the ids come out as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.rules = merge_table(path)
        self.words = _Words(self.rules)
        specials = sorted(self.rules.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.longest = max(map(len, specials), default=0)
        self._reset()

    def _reset(self) -> None:
        self.tail, self.run, self.stream = "", None, None

    def _push(self, text: str, last: bool) -> bytes:
        return np.array(self.stream.push(text.encode(), last), dtype="<u4").tobytes()

    def _segment(self, text: str, final: bool) -> Iterator[bytes]:
        """Text between special tokens; final: it ends here."""
        s = self.tail + text
        if self.run:
            end = RUNS[self.run].match(s).end()
            hold = int(self.run == "space")
            if end == len(s) and not final:
                yield self._push(s[: end - hold], False)
                self.tail = s[end - hold :]
                return
            cut = end - hold if end < len(s) else end
            yield self._push(s[:cut], True)
            s, self.run, self.stream = s[cut:], None, None
        words = SPLIT.findall(s)
        kept, last = len(s), len(words)
        if not final:
            while last and len(s) - kept < HELD:
                last -= 1
                kept -= len(words[last])
            if last == len(words) - 1 and not last and len(s) >= 2 * BLOCK:
                kind = next(k for k, p in RUNS.items() if p.fullmatch(s[-1]))
                self.run, self.stream = kind, WordTransducer(self.rules)
                hold = int(kind == "space")
                self.tail = s[len(s) - hold :]
                yield self._push(s[: len(s) - hold], False)
                return
            del words[last:]
        self.tail = s[kept:] if not final else ""
        yield b"".join(map(self.words.__getitem__, words))

    def encode(self, blocks: Iterable[str]) -> Iterator[bytes]:
        self._reset()
        buffer = ""
        for block in blocks:
            buffer += block
            if self.special:
                while found := self.special.search(buffer):
                    yield from self._segment(buffer[: found.start()], True)
                    yield np.array([self.rules.specials[found[0]]], dtype="<u4").tobytes()
                    buffer = buffer[found.end() :]
                held = next(
                    (k for k in range(min(self.longest - 1, len(buffer)), 0, -1) if any(x.startswith(buffer[-k:]) for x in self.rules.specials)), 0
                )
                yield from self._segment(buffer[: len(buffer) - held], False)
                buffer = buffer[len(buffer) - held :]
            else:
                yield from self._segment(buffer, False)
                buffer = ""
        yield from self._segment(buffer, True)


class Decoder:
    """Ids to text: a state machine over bytes that keeps at most the three bytes of an unfinished character."""

    def __init__(self, path: str):
        self.piece = merge_table(path).bytes.__getitem__

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            yield state.decode(b"".join(map(self.piece, np.frombuffer(part, dtype="<u4").tolist())))
        yield state.decode(b"", True)


def blocks(text: str | None) -> Iterator[str]:
    for at in range(0, len(text or ""), BLOCK):
        yield text[at : at + BLOCK]


def encode_text(text: str | None, path: str | None = None) -> list[int]:
    return np.frombuffer(b"".join(Encoder(path or default_path()).encode(blocks(text))), dtype="<u4").tolist()


def decode_ids(ids: Iterable[int], path: str | None = None) -> str:
    return "".join(Decoder(path or default_path()).decode([np.array(list(ids), dtype="<u4").tobytes()]))


def _out_schema(df: DataFrame, extra: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(extra).fields])


def bpe_encode(df: DataFrame, text: str = "text", path: str | None = None, digests_only: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, unless digests_only, ids (array of int).

    The decoded text is what the decoder makes of the ids, not the input."""
    path = path or default_path()
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *([] if digests_only else ["ids"])]
    df = without(df, *[n for n in names if n.lower() != text.lower()])
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(path), Decoder(path)
        for batch in batches:
            n, raw, back, ids = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                of_ids, of_text, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []

                def parts(value=value.as_py()):
                    nonlocal count
                    for part in encoder.encode(blocks(value)):
                        of_ids.update(part)
                        count += len(part) // 4
                        if not digests_only:
                            kept.append(part)
                        yield part

                for piece in decoder.decode(parts()):
                    of_text.update(piece.encode())
                n.append(count)
                raw.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
                ids.append(np.frombuffer(b"".join(kept), dtype="<u4").astype("<i4"))
            columns = [pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(back, pa.string())]
            if not digests_only:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, _out_schema(df, kinds))


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of an id array; null ids give an empty text."""
    path = path or default_path()
    df = without(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            texts = ["".join(decoder.decode([np.array(x.as_py() or [], dtype="<u4").tobytes()])) for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, _out_schema(df, f"{out} string"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded; per document the digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode(docs, digests_only=True)
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
