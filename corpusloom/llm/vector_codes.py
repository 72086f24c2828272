"""Vector code compression: product codes from Lloyd rounds whose parts wait in heaps until their bounds may be violated.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of up to 256 entries.
A block is some thousand vectors of one task with, for each part position and entry, a heap of the parts assigned to the
entry. A part's key is its lower bound (to the next nearest entry) minus its upper bound (to its own), plus the drift that
the entry had gathered when the part came: an entry gathers its own movement and the largest movement of any other, round
by round. As long as the drift so far is below the key, the part's nearest entry cannot have changed. A round therefore
looks at the tops of the heaps only, pops what the drift has reached, rescans exactly that against all entries, and pushes
it onto the heap of its nearest one. Popped parts that moved change their entries' sums by differences, which Spark adds
up; a round brings these sums to the driver, at most parts x entries x components numbers, and the new codebook goes
out. Blocks are rows of a table in the shared folder: a lost executor costs a round's blocks, and nothing is shuffled
but sums.

Exactness: distances are whole numbers, computed in double precision only where that is exact, else as long integers.
Bounds are square roots, widened by more than their rounding; a tie of bounds is rescanned.

Defined results: rows whose vector is null or holds null or non-finite components go; of equal ids the smaller vector
comes first among the first entries, rows without id last; repeated rows count each time; vectors shorter than the
longest are extended by zeros, and the length to a multiple of the number of parts; integers beyond 2^62 in size count as
that, errors beyond 64 bits as the largest 64-bit number; with fewer vectors than entries the codebook has one entry for
each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A block row (kind 0) has its vectors' length in `part` and the bytes of a component in `entry`; sums are rows of kind 1.
STATE = "kind int, ids array<long>, labels array<{label}>, comps binary, codes binary, keys binary, heaps binary, tops binary, part int, entry int, pos int, hi long, lo long"
#: Bytes of a block's components as 64-bit numbers, about.
BLOCK_BYTES = 1 << 21
#: Rows compared with all entries at a time.
SCAN = 4096
LARGEST, REACH = 2**63 - 1, 2**62
#: What bounds are widened by, and what the sum of a key and its drift may be rounded by.
SLACK, ROUNDING = 1e-9, 1e-14


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    wide = np.floor(values.astype(np.float64) * scale)
    return np.where(np.abs(wide) < REACH, wide, 0).astype(np.int64) + np.where(np.abs(wide) < REACH, 0, np.sign(wide)).astype(np.int64) * REACH


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """points x entries squared distances, exact: doubles that are whole numbers, or Python integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < 2**53:
        x, c = points.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    x, c = points.astype(object), entries.astype(object)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def own_squared(points: np.ndarray, entries: np.ndarray) -> list[int]:
    """The squared distance of each point to the entry in the same row."""
    apart = points.astype(object) - entries.astype(object) if max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 * 4 * max(1, points.shape[1]) >= 2**63 else points - entries
    return (apart * apart).sum(1).tolist()


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lower number at ties, and how much farther the next one surely is."""
    codes, slack = np.empty(len(points), np.int64), np.empty(len(points), np.float64)
    for lo in range(0, len(points), SCAN):
        d = squared(points[lo : lo + SCAN], entries)
        rows, best = np.arange(len(d)), d.argmin(1)
        upper = np.sqrt(d[rows, best].astype(np.float64)) * (1 + SLACK)
        if len(entries) > 1:
            d[rows, best] = d.max() + 1
            lower = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
        else:
            lower = np.full(len(d), np.inf)
        codes[lo : lo + SCAN], slack[lo : lo + SCAN] = best, lower - upper
    return codes, slack


class Heaps:
    """The heaps of one part position in a block, one for each entry: heap e holds the numbers of its parts in
    order[tops[e]:tops[e + 1]], by their keys. Only heaps that change are taken apart."""

    def __init__(self, keys: np.ndarray, order: np.ndarray, tops: np.ndarray):
        self.keys, self.order, self.tops = keys, order, tops
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, codes: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        """Sorted runs are heaps."""
        order = np.lexsort((keys, codes))
        return cls(keys, order, np.searchsorted(codes[order], np.arange(entries + 1)))

    def _opened(self, e: int) -> list[tuple[float, int]]:
        if e not in self.open:
            own = self.order[self.tops[e] : self.tops[e + 1]]
            self.open[e] = list(zip(self.keys[own].tolist(), own.tolist(), strict=True))
        return self.open[e]

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Takes out the parts whose key the drift of their entry has reached."""
        some, drift, out = np.flatnonzero(self.tops[1:] > self.tops[:-1]), drift * (1 + ROUNDING), []
        for e in some[self.keys[self.order[self.tops[some]]] <= drift[some]].tolist():
            heap, most = self._opened(e), drift[e]
            while heap and heap[0][0] <= most:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, rows: np.ndarray, codes: np.ndarray, keys: np.ndarray) -> None:
        self.keys[rows] = keys
        for row, code, key in zip(rows.tolist(), codes.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self._opened(code), (key, row))

    def close(self) -> None:
        if not self.open:
            return
        parts = [np.array([row for _, row in self.open[e]], np.int64) if e in self.open else self.order[self.tops[e] : self.tops[e + 1]] for e in range(len(self.tops) - 1)]
        self.order, self.tops, self.open = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])], {}


def _sums(parts: int, entries: int, wide: int):
    """Counts and sums for each part and entry, in two halves of 32 bits, which no task's rows overflow."""
    zero = lambda *s: np.zeros(s, np.int64)
    return zero(parts, entries), zero(parts, entries, wide), zero(parts, entries, wide)


def _add(sums, p: int, codes: np.ndarray, points: np.ndarray, sign: int) -> None:
    counts, high, low = sums
    np.add.at(counts[p], codes, sign)
    np.add.at(high[p], codes, sign * (points >> 32))
    np.add.at(low[p], codes, sign * (points & 0xFFFFFFFF))


def _sum_rows(sums, schema: pa.Schema) -> pa.RecordBatch:
    """The sums that are not zero, as rows of kind 1; position -1 holds the count."""
    counts, high, low = sums
    p, e = np.nonzero(counts)
    q, f, k = np.nonzero((high != 0) | (low != 0))
    cols = {"part": np.r_[p, q], "entry": np.r_[e, f], "pos": np.r_[np.full(len(p), -1), k], "hi": np.r_[np.zeros(len(p), np.int64), high[q, f, k]], "lo": np.r_[counts[p, e], low[q, f, k]]}
    n = len(cols["part"])
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.array([1] * n, f.type) if f.name == "kind" else pa.nulls(n, f.type) for f in schema], schema=schema)


def _block_row(schema: pa.Schema, ids: pa.Array, labels: pa.Array, comps: np.ndarray, codes: np.ndarray, heaps: list[Heaps]) -> pa.RecordBatch:
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)
    most = int(np.abs(comps).max(initial=0))
    small = np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
    cols = {
        "kind": pa.array([0], pa.int32()), "part": pa.array([comps.shape[1]], pa.int32()), "entry": pa.array([small.itemsize], pa.int32()), "ids": one(ids, schema.field("ids").type), "labels": one(labels, schema.field("labels").type), "comps": comps.astype(small).tobytes(),
        "codes": codes.astype(np.uint16).tobytes(), "keys": np.stack([h.keys for h in heaps]).tobytes(), "heaps": np.stack([h.order for h in heaps]).astype(np.int32).tobytes(), "tops": np.stack([h.tops for h in heaps]).astype(np.int32).tobytes(),
    }
    return pa.RecordBatch.from_arrays([cols[f.name] if isinstance(cols.get(f.name), pa.Array) else pa.array([cols[f.name]], f.type) if f.name in cols else pa.nulls(1, f.type) for f in schema], schema=schema)


def _first(codebook: np.ndarray, label_type: pa.DataType, block_bytes: int):
    """Rows (id, label, v) in, blocks with their first assignment and their sums out."""
    parts, entries, wide = codebook.shape
    schema = _schema(label_type)

    def block(ids: pa.Array, labels: pa.Array, comps: np.ndarray, sums) -> pa.RecordBatch:
        codes, heaps = np.empty((parts, len(comps)), np.int64), []
        for p in range(parts):
            own = comps[:, p * wide : (p + 1) * wide]
            codes[p], keys = nearest(own, codebook[p])
            heaps.append(Heaps.of(codes[p], keys, entries))
            _add(sums, p, codes[p], own, 1)
        return _block_row(schema, ids, labels, comps, codes, heaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = _sums(parts, entries, wide), max(1, block_bytes // (8 * max(1, parts * wide)))
        for whole in batches:
            for lo in range(0, len(whole), most):
                batch = whole.slice(lo, most)
                yield block(batch.column(0), batch.column(1), _integers(batch.column(2), parts * wide), sums)
        yield _sum_rows(sums, schema)

    return run


def _integers(vectors: pa.Array, wide: int) -> np.ndarray:
    """Vectors as rows of integers, shorter ones extended by zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = to_integers(vectors.flatten().to_numpy(zero_copy_only=False))
    if (sizes == wide).all():
        return flat.reshape(len(vectors), wide)
    out = np.zeros((len(vectors), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _schema(label_type: pa.DataType) -> pa.Schema:
    whole, raw = pa.int32(), pa.binary()
    return pa.schema([("kind", whole), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(label_type)), ("comps", raw), ("codes", raw), ("keys", raw), ("heaps", raw), ("tops", raw), ("part", whole), ("entry", whole), ("pos", whole), ("hi", pa.int64()), ("lo", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, list[Heaps]]]:
    for batch in batches:
        for i in range(len(batch)):
            at = lambda c, kind: np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_py(), kind)  # noqa: B023, E731
            ids, labels = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("ids", "labels"))
            n = len(ids)
            codes = at("codes", np.uint16).reshape(parts, n).astype(np.int64)
            wide, size = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("part", "entry"))
            comps = at("comps", f"i{size}").astype(np.int64).reshape(n, wide)
            keys, order, tops = at("keys", np.float64).reshape(parts, n), at("heaps", np.int32).reshape(parts, n), at("tops", np.int32).reshape(parts, entries + 1)
            yield ids, labels, comps, codes, [Heaps(keys[p].copy(), order[p].astype(np.int64), tops[p].astype(np.int64)) for p in range(parts)]


def _round(codebook: np.ndarray, drift: np.ndarray, label_type: pa.DataType):
    """Blocks in, blocks after the round out, with the differences of their sums."""
    parts, entries, wide = codebook.shape
    schema = _schema(label_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _sums(parts, entries, wide)
        for ids, labels, comps, codes, heaps in _blocks(batches, parts, entries):
            for p in range(parts):
                rows = heaps[p].pop(drift[p])
                if not len(rows):
                    continue
                own = comps[rows, p * wide : (p + 1) * wide]
                now, slack = nearest(own, codebook[p])
                moved = now != codes[p, rows]
                _add(sums, p, codes[p, rows[moved]], own[moved], -1)
                _add(sums, p, now[moved], own[moved], 1)
                codes[p, rows] = now
                heaps[p].push(rows, now, slack + drift[p, now])
                heaps[p].close()
            yield _block_row(schema, ids, labels, comps, codes, heaps)
        yield _sum_rows(sums, schema)

    return run


def _codes(codebook: np.ndarray, label_type: pa.DataType):
    """Blocks in, (vec_id, label, code, error) out."""
    parts, entries, wide = codebook.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, comps, codes, _ in _blocks(batches, parts, entries):
            error = [0] * len(ids)
            for p in range(parts):
                error = [a + b for a, b in zip(error, own_squared(comps[:, p * wide : (p + 1) * wide], codebook[p, codes[p]]), strict=True)]
            text = [row.tobytes().hex() for row in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array([min(e, LARGEST) for e in error], pa.int64())], schema=schema)

    return run


class VectorCodes:
    """Codebooks and codes of a table of vectors. After fit(): `codebook` (parts x entries x components)."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES):
        if entries > 256:
            raise ValueError("a code has eight bits a part")
        self.spark, self.parts, self.entries, self.rounds, self.block_bytes = df.sparkSession, parts, entries, rounds, block_bytes
        self.scratch = Scratch(self.spark, "vector-codes")
        kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("v"))
        self.rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        self.label = self.rows.schema["label"].dataType

    def _start(self) -> np.ndarray:
        """The parts of the smallest ids: at most `entries` rows come to the driver."""
        longest = self.rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
        wide = -(-(longest or 0) // self.parts)
        first = self.rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(self.entries).collect()
        whole = np.zeros((len(first), self.parts * wide), np.int64)
        for row, r in zip(whole, first, strict=True):
            row[: len(r["v"])] = to_integers(np.array(r["v"], np.float64))
        return whole.reshape(len(first), self.parts, wide).transpose(1, 0, 2).copy()

    def fit(self) -> VectorCodes:
        from pyspark.sql.pandas.types import to_arrow_type

        self.codebook, self.arrow_label = self._start(), to_arrow_type(self.label)
        parts, entries, wide = self.codebook.shape
        self.state = None
        if not entries:
            return self
        schema = STATE.format(label=self.label.simpleString())
        state = self.scratch.put(self.rows.mapInArrow(_first(self.codebook, self.arrow_label, self.block_bytes), schema))
        totals = np.zeros((parts, entries, wide + 1), object)  # the last is the count
        drift = np.zeros((parts, entries))
        for _ in range(self.rounds):
            for r in state.filter("kind = 1").groupBy("part", "entry", "pos").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():
                totals[r["part"], r["entry"], r["pos"]] += r["hi"] * 2**32 + r["lo"]
            before, self.codebook = self.codebook, self.codebook.copy()
            for p, e in zip(*np.nonzero(totals[:, :, -1]), strict=True):
                self.codebook[p, e] = [total // totals[p, e, -1] for total in totals[p, e, :-1]]
            drift = drift + _drift(before, self.codebook)
            after = self.scratch.put(state.filter("kind = 0").mapInArrow(_round(self.codebook, drift, self.arrow_label), schema))
            self.scratch.drop(state)
            state = after
        self.state = state.filter("kind = 0")
        return self

    def encode(self) -> DataFrame:
        """(vec_id, label, code, error)"""
        schema = f"vec_id long, label {self.label.simpleString()}, code string, error long"
        if self.state is None:
            return self.spark.createDataFrame([], schema)
        return self.state.mapInArrow(_codes(self.codebook, self.arrow_label), schema)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebook.ravel().tolist())).encode()).hexdigest()


def _drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each entry gathers: its own movement and the largest of any other of its codebook, rounded up."""
    moved = np.stack([np.sqrt(np.array([float(x) for x in own_squared(b, a)])) * (1 + SLACK) for b, a in zip(before, after, strict=True)])
    out = np.empty_like(moved)
    for p, own in enumerate(moved):
        rank = np.argsort(own)
        most, next_ = own[rank[-1]], own[rank[-2]] if len(own) > 1 else 0.0
        out[p] = own + np.where(np.arange(len(own)) == rank[-1], next_, most)
    return out


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable row."""
    model = VectorCodes(df, id_col, vector, label, parts, entries, rounds, block_bytes).fit()
    coded = model.scratch.put(model.encode())
    # a row for each label, written: the planner broadcasts it by its size, or joins by sort-merge
    of_label = model.scratch.put(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")))
    of_label = of_label.select(F.col("label").alias("of"), F.least(F.col("total"), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four codes of 256 entries after four rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _round_sql(k: int) -> str:
    """The assignment to codebook k and, but for the last, codebook k + 1."""
    near = f"""near{k} AS (
  SELECT x.vec_id, x.p, e.entry, list_sum(list_transform(range(1, len(x.part) + 1), lambda i: (x.part[i] - e.part[i]) * (x.part[i] - e.part[i])))::BIGINT AS d
  FROM parts x JOIN book{k} e ON x.p = e.p QUALIFY row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY d, e.entry) = 1
)"""
    if k == ROUNDS:
        return near
    return f"""{near},
mean{k} AS (
  SELECT p, entry, list(m ORDER BY i) AS part FROM (
    SELECT p, entry, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT n.p, n.entry, unnest(range(1, len(x.part) + 1)) AS i, unnest(x.part) AS c FROM near{k} n JOIN parts x ON x.vec_id = n.vec_id AND x.p = n.p)
    GROUP BY p, entry, i
  ) GROUP BY p, entry
),
book{k + 1} AS (SELECT b.p, b.entry, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.entry = b.entry)"""


OP12_SQL = f"""
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS part FROM usable, range({PARTS}) AS ps(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part FROM parts QUALIFY entry < {ENTRIES}),
{", ".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id
),
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY u.label))::BIGINT AS label_error, d.codebooks_sha256
FROM coded c JOIN usable u ON u.vec_id = c.vec_id CROSS JOIN digest d
"""
