"""Folds over the records of a key in order, where no window frame expresses the state.

A fold streams: records are dealt out by key and sorted in each partition, and the state is carried
from one Arrow batch to the next, so memory does not grow with a key's records. A step takes a
record; where a state changes seldom, a fold also has `many`, which takes a key's records of a batch
at once and goes from change to change.

A token bucket's key need not be one task's: `stretched_bucket` finds what each stretch of its records
does to any state, composes these, and folds all stretches side by side.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

Step = Callable[[Any, tuple], tuple[Any, tuple]]
#: Records of a key in a batch from which on they are taken at once.
LONG = 64


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Any, step: Step, adds: str) -> DataFrame:
    """All columns of `rows` and those of `adds` (DDL), which `step(state, inputs)` returns with the next state.

    The state begins as `start` for each combination of `keys`; a null key is a key.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    added = _parse_datatype_string(adds)
    assert isinstance(added, StructType)
    schema = StructType([*rows.schema.fields, *(StructField(f.name, f.dataType, True) for f in added.fields)])
    names, many = [f.name for f in added.fields], getattr(step, "many", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        now: Any = None
        state = start
        for batch in batches:
            at = batch.schema.names
            columns = [batch.column(at.index(k)) for k in keys]
            values = [batch.column(at.index(c)) for c in inputs]
            out: list[list] = [[] for _ in names]
            for a, b in _runs(columns, batch.num_rows):
                key = tuple(c[a].as_py() for c in columns)
                if key != now:
                    now, state = key, start
                here = [v.slice(a, b - a) for v in values]
                if many and b - a >= LONG and not any(v.null_count for v in here):
                    state, got = many(state, *(v.to_numpy(zero_copy_only=False) for v in here))
                    for column, x in zip(out, got, strict=True):
                        column += x.tolist()
                    continue
                for value in zip(*(v.to_pylist() for v in here), strict=True):
                    state, got = step(state, value)
                    for column, x in zip(out, got, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*at, *names])

    return dealt.mapInArrow(run, schema)


def _runs(columns: list[pa.Array], n: int) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys begin and end; nulls are equal."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        code = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    cut = [*np.flatnonzero(new).tolist(), n]
    return zip(cut, cut[1:], strict=False)


def _first(holds: Callable[[int, int], np.ndarray], at: int, n: int) -> int:
    """The first place from `at` on for which `holds(a, b)`, the flags of a stretch, is true; n if there is none. It looks at twice as many each time."""
    size = 64
    while at < n:
        b = min(n, at + size)
        found = np.flatnonzero(holds(at, b))
        if len(found):
            return at + int(found[0])
        at, size = b, 2 * size
    return n


def greedy_chunks(limit: int) -> tuple[tuple[int, int], Step]:
    """Chunks that close with the record that fills them to `limit`. Gives a record's chunk number."""

    def step(state: tuple[int, int], value: tuple) -> tuple[tuple[int, int], tuple]:
        chunk, filled = state
        filled += value[0] or 0
        return ((chunk + 1, 0) if filled >= limit else (chunk, filled)), (chunk,)

    def many(state: tuple[int, int], size: np.ndarray) -> tuple[tuple[int, int], tuple]:
        chunk, filled = state
        total, out, at, base = np.cumsum(size) + filled, np.zeros(len(size), np.int64), 0, 0
        while at < len(size):
            end = int(np.searchsorted(total, base + limit))
            out[at : end + 1] = chunk
            if end >= len(size):
                return (chunk, int(total[-1]) - base), (out,)
            chunk, base, at = chunk + 1, int(total[end]), end + 1
        return (chunk, 0), (out,)

    step.many = many  # type: ignore[attr-defined]
    return (0, 0), step


def age_chunks(linger: int) -> tuple[tuple[int, int | None], Step]:
    """Chunks that close before the first record that comes `linger` or more after their first."""

    def step(state: tuple[int, int | None], value: tuple) -> tuple[tuple[int, int | None], tuple]:
        chunk, created = state
        if created is not None and value[0] - created >= linger:
            chunk, created = chunk + 1, None
        created = value[0] if created is None else created
        return (chunk, created), (chunk,)

    def many(state: tuple[int, int | None], at: np.ndarray) -> tuple[tuple[int, int | None], tuple]:
        chunk, created = state
        out, i, n = np.zeros(len(at), np.int64), 0, len(at)
        created = int(at[0]) if created is None else created
        while i < n:
            end = _first(lambda a, b: at[a:b] - created >= linger, i, n)  # noqa: B023
            out[i:end] = chunk
            if end < n:
                chunk, created = chunk + 1, int(at[end])
            i = end
        return (chunk, created), (out,)

    step.many = many  # type: ignore[attr-defined]
    return (0, None), step


def rotation(limit: int, age: int) -> tuple[tuple[int, int, int | None], Step]:
    """Segments that close before the first record that comes when they hold `limit` bytes or are `age` old. Values are (size, time)."""

    def step(state: tuple[int, int, int | None], value: tuple) -> tuple[tuple[int, int, int | None], tuple]:
        segment, filled, made = state
        size, at = value
        if made is not None and (filled >= limit or at - made >= age):
            segment, filled, made = segment + 1, 0, None
        return (segment, filled + size, at if made is None else made), (segment,)

    def many(state: tuple[int, int, int | None], size: np.ndarray, at: np.ndarray) -> tuple[tuple[int, int, int | None], tuple]:
        segment, filled, made = state
        out, i, n = np.zeros(len(at), np.int64), 0, len(at)
        before = np.cumsum(size) - size + filled  # bytes before each record, less `base` those of its segment
        base = 0
        if made is None:
            made = int(at[0])
        while i < n:
            full = int(np.searchsorted(before, base + limit))
            end = _first(lambda a, b: at[a:b] - made >= age, i, min(n, max(full, i)))  # noqa: B023
            out[i:end] = segment
            if end < n:
                segment, base, made = segment + 1, int(before[end]), int(at[end])
                out[end] = segment
                end += 1
            i = end
        return (segment, int(before[-1] + size[-1]) - base, made), (out,)

    step.many = many  # type: ignore[attr-defined]
    return (0, 0, None), step


def sparse_index(interval: int, index_first: bool = False) -> tuple[tuple[int, int], Step]:
    """Whether a record of a given frame size gets an index entry, and its position in the segment."""

    def step(state: tuple[int, int], value: tuple) -> tuple[tuple[int, int], tuple]:
        position, indexed = state
        entry = position - indexed >= interval or (index_first and position == 0)
        return (position + value[0], position if entry else indexed), (position, entry)

    def many(state: tuple[int, int], size: np.ndarray) -> tuple[tuple[int, int], tuple]:
        position, indexed = state
        places = np.cumsum(size) - size + position
        entry = (places == 0) if index_first else np.zeros(len(size), bool)
        at = 0
        while (at := max(at, int(np.searchsorted(places, indexed + interval)))) < len(size):
            entry[at], indexed = True, int(places[at])
            at += 1
        return (int(places[-1] + size[-1]), indexed), (places, entry)

    step.many = many  # type: ignore[attr-defined]
    return (0, 0), step


def sequence_check() -> tuple[int | None, Step]:
    """ACCEPT, DUPLICATE, GAP or OLD for each sequence number of a producer; only accepted ones move the state."""

    def step(last: int | None, value: tuple) -> tuple[int | None, tuple]:
        seq = value[0]
        if last is None or seq == last + 1:
            return seq, ("ACCEPT",)
        return last, ("DUPLICATE" if seq == last else "GAP" if seq > last else "OLD",)

    def many(last: int | None, seq: np.ndarray) -> tuple[int | None, tuple]:
        n, i = len(seq), 0
        out = np.full(n, "ACCEPT", object)
        ends = np.append(np.flatnonzero(seq[1:] != seq[:-1] + 1) + 1, n)  # where a run of numbers in a row ends
        while i < n:
            go = i if last is None else _first(lambda a, b: seq[a:b] == last + 1, i, n)  # noqa: B023
            if go > i:
                other = seq[i:go]
                out[i:go] = np.where(other == last, "DUPLICATE", np.where(other > last, "GAP", "OLD"))
            if go < n:
                i = int(ends[np.searchsorted(ends, go, "right")])
                last = int(seq[i - 1])
            else:
                i = n
        return last, (out,)

    step.many = many  # type: ignore[attr-defined]
    return None, step


def adaptive_size(first: int = 65536, least: int = 4096, most: int = 1 << 20) -> tuple[tuple[int, int, int], Step]:
    """The size of each fetch, given how many bytes it got: doubled after three full ones, halved after five near-empty ones."""

    def step(state: tuple[int, int, int], value: tuple) -> tuple[tuple[int, int, int], tuple]:
        size, full, empty = state
        used = value[0] / size
        full, empty = (full + 1, 0) if used >= 0.9 else (0, empty + 1) if used < 0.3 else (0, 0)
        after = size
        if full >= 3:
            after, full = min(2 * size, most), 0
        elif empty >= 5:
            after, empty = max(size // 2, least), 0
        return (after, full, empty), (after,)

    return (first, 0, 0), step


def token_bucket(rate: int) -> tuple[tuple[int, int | None], Step]:
    """When each (time in ms, bytes) may go, in ms; null for one larger than a second's rate. The bucket starts empty, in thousandths of a byte."""

    def step(state: tuple[int, int | None], value: tuple) -> tuple[tuple[int, int | None], tuple]:
        tokens, last = state
        arrives, size = value
        if size > rate:
            return state, (None,)
        now = arrives if last is None else max(arrives, last)
        if last is not None:
            tokens = min(1000 * rate, tokens + (now - last) * rate)
        wait = max(0, -(-(1000 * size - tokens) // rate))
        tokens = min(1000 * rate, tokens + wait * rate) - 1000 * size
        return (tokens, now + wait), (now + wait,)

    return (0, None), step


class Bucket:
    """A token bucket as `token_bucket` has it, by a state that stretches of requests map and that these maps compose on.

    The state is (level, last): `last` is when the last request went, and `level` is `last * rate` less the tokens then,
    which stays as it is while tokens flow in. A request (at, need in thousandths of a byte) is

        now = max(at, last); level = max(level, now * rate - full)
        last = max(now, ceil((level + need) / rate)); level = max(level, last * rate - full) + need

    All of this is maxima and sums, and the rounding up goes through a maximum and through sums with `rate`. So a stretch
    maps a state to the maximum of what comes of no state, of `last` alone and of `level` alone, the two last without
    arrivals, and for `level` the remainders by `rate` are all there is to know.
    """

    #: No state at all; far below any time of Spark's in units of level.
    NONE = -(1 << 62)

    def __init__(self, rate: int):
        assert 0 < rate <= 1_000_000, rate  # levels are 64 bits
        self.rate, self.full = rate, 1000 * rate
        self.nothing = (self.NONE, self.NONE // rate)

    def request(self, level: Any, last: Any, need: int) -> tuple[Any, Any]:
        """What comes of states, arrays or numbers, after one request; its arrival is in `last`."""
        most = np.maximum if isinstance(level, np.ndarray) else max
        level = most(level, last * self.rate - self.full)
        last = most(last, -(-(level + need) // self.rate))
        return most(level, last * self.rate - self.full) + need, last

    def pieces(self, need: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        """From where to where requests are such that the level goes up by their needs and nothing else; others come one by one, and false."""
        odd = np.flatnonzero((need < 0) | (need > self.full - self.rate + 1)).tolist()
        at = 0
        for i in [*odd, len(need)]:
            if i > at:
                yield at, i, True
            if i < len(need):
                yield i, i + 1, False
            at = i + 1

    def fold(self, state: tuple[int, int], at: np.ndarray, need: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
        """The state after requests, and when each goes."""
        level, last = state
        goes = np.empty(len(at), np.int64)
        for a, b, plain in self.pieces(need):
            if plain:
                upto = np.cumsum(need[a:b])
                free = np.maximum.accumulate(at[a:b] * self.rate - self.full - upto + need[a:b])
                levels = np.maximum(free, max(level, last * self.rate - self.full)) + upto
                goes[a:b] = np.maximum(np.maximum(np.maximum.accumulate(at[a:b]), last), -(-levels // self.rate))
                level, last = int(levels[-1]), int(goes[b - 1])
            else:
                level, last = self.request(level, max(last, int(at[a])), int(need[a]))
                goes[a] = last
        return (level, last), goes

    def start(self, first: int) -> tuple[int, int]:
        """The state of an empty bucket before its first request, which comes at `first`."""
        return first * self.rate, first


class Effect:
    """What a stretch of a bucket's requests does to any state before it."""

    def __init__(self, bucket: Bucket):
        self.bucket, self.state, self.first = bucket, bucket.nothing, None
        # A level of each remainder without a last, and in the end a last of 0 without a level. Equal results are kept once, from `since` on.
        self.since = np.arange(bucket.rate + 1)
        self.level = np.append(self.since[:-1], bucket.NONE)
        self.last = np.append(np.full(bucket.rate, bucket.nothing[1]), 0)

    def add(self, at: np.ndarray, need: np.ndarray) -> None:
        if len(at) and self.first is None:
            self.first = int(at[0])
        self.state, _ = self.bucket.fold(self.state, at, need)
        for a, b, plain in self.bucket.pieces(need):
            if plain:
                self.level = np.maximum(self.level, self.last * self.bucket.rate - self.bucket.full) + int(need[a:b].sum())
                self.last = np.maximum(self.last, -(-self.level // self.bucket.rate))
            else:
                self.level, self.last = self.bucket.request(self.level, self.last, int(need[a]))
                new = np.ones(len(self.level), bool)
                new[1:-1] = (self.level[1:-1] != self.level[:-2]) | (self.last[1:-1] != self.last[:-2])
                if not new.all():
                    self.since, self.level, self.last = self.since[new], self.level[new], self.last[new]

    def packed(self) -> bytes:
        """All but `first`; a few hundred bytes where remainders are not told apart often."""
        table = np.stack([self.since, self.level, self.last])
        return zlib.compress(np.concatenate([np.array([self.state]).T.ravel(), np.diff(table, prepend=0).ravel()]).astype("<i8").tobytes())


def after(bucket: Bucket, packed: bytes, state: tuple[int, int]) -> tuple[int, int]:
    """The state after a stretch whose effect was packed."""
    found = np.frombuffer(zlib.decompress(packed), "<i8")
    since, levels, lasts = np.cumsum(found[2:].reshape(3, -1), axis=1)
    turns, rest = divmod(state[0], bucket.rate)
    i = int(np.searchsorted(since[:-1], rest, "right")) - 1
    level = max(int(found[0]), int(levels[i]) + turns * bucket.rate, int(levels[-1]) + state[1] * bucket.rate)
    return level, max(int(found[1]), int(lasts[i]) + turns, int(lasts[-1]) + state[1])


def stretched_bucket(rows: DataFrame, keys: list[str], stretch: str, order: list[str], inputs: tuple[str, str], rate: int, name: str, tasks: int) -> DataFrame:
    """What `ordered_fold` gives with `token_bucket(rate)`, a task holding a stretch of a key's records at a time.

    `stretch` is a column that isn't null and rises with the order; a key's are dealt to `tasks` in turn. A first job finds each stretch's effect, and the driver
    composes them, some hundred bytes a stretch; then stretches are folded side by side. In the result `stretch` is one by the
    new column: how many of the key's stretches have ended before that time.
    """
    bucket, by = Bucket(rate), [*keys, stretch]
    turn = F.pmod(F.col(stretch) + (F.hash(*keys) if keys else F.lit(0)), F.lit(tasks)).cast("int")
    dealt = lambda found: found.repartitionById(tasks, turn).sortWithinPartitions(*by, *order)
    kept = dealt(rows.select(*dict.fromkeys([*by, *order, *inputs])))
    kinds = StructType([*(kept.schema[k] for k in by), *_parse_datatype_string("_first long, _effect binary").fields])  # type: ignore[attr-defined]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of a stretch: its key, from where to where, which requests are not too large, their times and needs."""
        at = batch.schema.names
        columns = [batch.column(at.index(k)) for k in by]
        times, sizes = (batch.column(at.index(c)) for c in inputs)
        if sizes.null_count:
            raise TypeError(f"{inputs[1]} is null")
        fits = sizes.to_numpy(zero_copy_only=False) <= rate
        if times.null_count and times.filter(pa.array(fits)).null_count:
            raise TypeError(f"{inputs[0]} is null")
        arrives, needs = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (times, sizes))
        for a, b in _runs(columns, batch.num_rows):
            fit = fits[a:b]
            yield tuple(c[a].as_py() for c in columns), a, b, fit, arrives[a:b][fit], 1000 * needs[a:b][fit]

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        now: Any = None
        effect = Effect(bucket)
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*now, effect.first, effect.packed()), strict=True))], to_arrow_schema(kinds))
        for batch in batches:
            for key, _, _, _, at, need in parts(batch):
                if key != now:
                    if effect.first is not None:
                        yield row()
                    now, effect = key, Effect(bucket)
                effect.add(at, need)
        if effect.first is not None:
            yield row()

    starts: dict[tuple, tuple[int, int]] = {}
    ends: dict[tuple, list[int]] = {}
    states: dict[tuple, tuple[int, int]] = {}
    for *key, number, first, effect in sorted(kept.mapInArrow(effects, kinds).collect(), key=lambda r: r[stretch]):
        state = starts[(*key, number)] = states.get(tuple(key)) or bucket.start(first)
        states[tuple(key)] = state = after(bucket, bytes(effect), state)
        ends.setdefault(tuple(key), []).append(state[1])
    schema = StructType([*rows.schema.fields, StructField(name, LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state = bucket.nothing
        for batch in batches:
            goes, later = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            refused = np.ones(batch.num_rows, bool)
            for key, a, b, fit, at, need in parts(batch):
                if key != now:
                    now, state = key, starts.get(key, bucket.nothing)
                state, found = bucket.fold(state, at, need)
                goes[a:b][fit] = found
                later[a:b][fit] = np.searchsorted(ends.get(key[:-1], []), found)
                refused[a:b] = ~fit
            names = batch.schema.names
            columns = [pa.array(later, batch.column(i).type) if n == stretch else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(goes, mask=refused)], [*names, name])

    return dealt(rows).mapInArrow(run, schema)


def circuit_breaker(failures: int = 5, pause: int = 60_000, successes: int = 2) -> tuple[tuple[str, int, int, int], Step]:
    """The breaker's state before and after each (time in ms, succeeded), and whether the call was let through.

    A success forgets the failures before it, so while half open one failure after a success doesn't open it again;
    the successes counted while half open are kept when it does open.
    """

    def step(state: tuple[str, int, int, int], value: tuple) -> tuple[tuple[str, int, int, int], tuple]:
        name, failed, went, last = state
        at, ok = value
        if name == "OPEN" and at - last >= pause:
            name = "HALF_OPEN"
        before, let = name, name != "OPEN"
        if let and ok:
            failed = 0
            went += name == "HALF_OPEN"
            if name == "HALF_OPEN" and went >= successes:
                name, went = "CLOSED", 0
        elif let:
            failed, last = failed + 1, at
            name = "OPEN" if failed >= failures else name
        return (name, failed, went, last), (before, let, name)

    return ("CLOSED", 0, 0, 0), step


def shared_cursor() -> tuple[int, Step]:
    """Where each topic's turn begins: the place among its subscribers of the first from the cursor on, which then moves past the last that got a partition.

    Values are (numbers of the topic's subscribers among all members in order, partitions, members).
    """

    def step(cursor: int, value: tuple) -> tuple[int, tuple]:
        numbers, partitions, members = value
        if not numbers or not partitions:
            return cursor, (0,)
        first = bisect_left(numbers, cursor) % len(numbers)
        return (numbers[(first + partitions - 1) % len(numbers)] + 1) % members, (first,)

    return 0, step
