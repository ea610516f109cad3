"""DNS bodies and dnstap frames of a whole batch, decoded column by column.

The messages of a batch lie in one buffer. A cursor per message moves over it, and all cursors take one label, one record or
one field per step, so the work per step is a few array operations however many messages there are. Columns are
built from positions in the buffer. Messages that break a rule on the way, or have more than one question, are left to
the functions of `wire`, one by one; they also say what is wrong with them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dnsflow.operators import wire

DOT = ord(".")
_OCTETS = pa.array([str(i) for i in range(256)])
SECTIONS = ("answer_rrs", "authority_rrs", "additional_rrs")


class Batch:
    """The bytes of a binary column, with the first and the last position of every value."""

    def __init__(self, values: pa.Array):
        if pa.types.is_large_binary(values.type):
            values = values.cast(pa.binary())
        _, offsets, data = values.buffers()
        n = len(values)
        edges = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        low, high = int(edges[0]), int(edges[-1])
        # reads that look a little over the end of the last value stay inside
        self.data = np.concatenate([held[low:high], np.zeros(16, dtype=np.uint8)])
        self.start, self.end = edges[:-1] - low, edges[1:] - low
        self.present = ~values.is_null().to_numpy(zero_copy_only=False)

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        """Big-endian numbers at these positions."""
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(size):
            out = out << 8 | self.data[np.minimum(at + k, len(self.data) - 1)]
        return out

    def value(self, row: int) -> bytes:
        return self.data[self.start[row] : self.end[row]].tobytes()


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _binary(data: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """A binary column of consecutive bytes cut into these sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    valid, nulls = None, 0
    if missing is not None and missing.any():
        valid, nulls = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes()), int(missing.sum())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())], nulls)


def _cut(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """A binary column of the bytes at these positions."""
    if missing is not None:
        sizes = np.where(missing, 0, sizes)
    return _binary(data[np.repeat(at, sizes) + _within(sizes)], sizes, missing)


def _text(values: pa.Array) -> pa.Array:
    """Text of bytes; what is no UTF-8 is replaced."""
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def _names(data: np.ndarray, owner: np.ndarray, at: np.ndarray, sizes: np.ndarray, n: int) -> pa.Array:
    """Dotted names from labels: which name a label belongs to (labels of a name in order), where it is, its size."""
    order = np.argsort(owner, kind="stable")
    owner, at, sizes = owner[order], at[order], sizes[order]
    inside = _within(sizes + 1)
    spread = np.repeat(sizes, sizes + 1)
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    point = inside == spread
    text = np.where(point, DOT, data[np.repeat(at, sizes + 1) + np.where(point, 0, inside)]).astype(np.uint8)
    kept = ~(point & np.repeat(last, sizes + 1))
    lengths = np.bincount(owner, weights=sizes + 1 - last, minlength=n).astype(np.int64)
    return _text(_binary(text[kept], lengths))


def _read_names(batch: Batch, rows: np.ndarray, at: np.ndarray, collect: bool):
    """(position behind the name or -1 if it breaks a rule, labels as (index into rows, position, size)) of names at these positions."""
    start, end = batch.start[rows], batch.end[rows]
    pos, after = at.copy(), np.full(len(rows), -1)
    jumped, size = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=np.int64)
    going, found = np.arange(len(rows)), []
    while len(going):
        p = pos[going]
        inside = p < end[going]
        going, p = going[inside], p[inside]
        length = batch.data[p].astype(np.int64)
        pointer = length & 0xC0 == 0xC0
        i, here = going[pointer], p[pointer]
        target = start[i] + ((length[pointer] & 0x3F) << 8 | batch.data[here + 1])
        good = (here + 2 <= end[i]) & (target < here)
        i, here, target = i[good], here[good], target[good]
        fresh = ~jumped[i]
        after[i[fresh]] = here[fresh] + 2  # taken back below if the name breaks a rule later
        jumped[i], pos[i] = True, target
        hops = i
        i, here, length = going[~pointer], p[~pointer], length[~pointer]
        done = i[length == 0]
        after[done[~jumped[done]]] = here[length == 0][~jumped[done]] + 1
        size[done] = -1  # ended well
        label = (length > 0) & (length <= wire.MAX_LABEL)
        i, here, length = i[label], here[label], length[label]
        good = (size[i] + length + 1 <= wire.MAX_NAME) & (here + length < end[i])
        i, here, length = i[good], here[good], length[good]
        size[i] += length + 1
        pos[i] = here + length + 1
        if collect:
            found.append((i, here + 1, length))
        going = np.concatenate([hops, i])
    after[size != -1] = -1
    none = np.empty(0, dtype=np.int64)
    return after, tuple(np.concatenate([none, *[f[k] for f in found]]) for k in range(3))


def _question(batch: Batch, rows: np.ndarray):
    """(position of the closing zero or -1, labels) of the first question's name, which is not compressed."""
    at, end = batch.start[rows] + 12, batch.end[rows]
    zeros = np.append(np.flatnonzero(batch.data == 0), len(batch.data))
    close = zeros[np.searchsorted(zeros, at)]
    good = (end - at >= 5) & (close < end) & (close - at <= wire.MAX_NAME) & (end - close >= 5)
    pos, going, found = at.copy(), np.flatnonzero(good), []
    while len(going):
        length = batch.data[pos[going]].astype(np.int64)
        bad = (length > wire.MAX_LABEL) | ((length > 0) & (pos[going] + length + 1 > close[going]))
        good[going[bad]] = False
        on = ~bad & (length > 0)
        going, length = going[on], length[on]
        found.append((going, pos[going] + 1, length))
        pos[going] += length + 1
    none = np.empty(0, dtype=np.int64)
    return np.where(good, pos, -1), tuple(np.concatenate([none, *[f[k] for f in found]]) for k in range(3))


class _Records:
    """The kept records of all messages, step by step."""

    def __init__(self):
        self.parts, self.labels, self.n = [], [], 0

    def add(self, labels, keep: np.ndarray, **columns: np.ndarray) -> None:
        place = np.full(len(keep), -1)
        place[keep] = self.n + np.arange(keep.sum())
        self.n += int(keep.sum())
        self.parts.append({c: v[keep] for c, v in columns.items()})
        of = place[labels[0]]
        self.labels.append(tuple(x[of >= 0] for x in (of, *labels[1:])))

    def column(self, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype=np.int64), *[p[name] for p in self.parts]])

    def names(self, data: np.ndarray) -> pa.Array:
        none = np.empty(0, dtype=np.int64)
        return _names(data, *[np.concatenate([none, *[x[k] for x in self.labels]]) for k in range(3)], self.n)


def _rdata(batch: Batch, row: np.ndarray, kind: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Text of all record data, and the rows whose data breaks a rule. Addresses are laid out as columns, other types have their own text."""
    plain = (kind == wire.TYPE_A) & (size == 4)
    octets = [_OCTETS.take(pa.array(batch.data[at[plain] + k].astype(np.int64))) for k in range(4)]
    addresses = pc.binary_join_element_wise(*octets, ".")
    others, texts, broken = np.flatnonzero(~plain), [], []
    held: tuple[int, bytes] = (-1, b"")
    for i in others.tolist():
        r = int(row[i])
        if held[0] != r:
            held = (r, batch.value(r))
        low = int(batch.start[r])
        try:
            texts.append(wire.rdata_text(held[1], int(kind[i]), int(at[i]) - low, int(size[i]), len(held[1])))
        except wire.Malformed:
            texts.append(None)
            broken.append(r)
    place = np.empty(len(kind), dtype=np.int64)
    place[plain], place[others] = np.arange(plain.sum()), plain.sum() + np.arange(len(others))
    return pa.concat_arrays([addresses, pa.array(texts, pa.string())]).take(pa.array(place)), np.array(broken, dtype=np.int64)


def bodies(values: pa.Array, with_rrs: bool, kind: pa.StructType) -> pa.Array:
    """What `wire.decode_message` gives for every value, as one struct column with `body_error`."""
    batch = Batch(values)
    n, data = len(values), batch.data
    good = batch.present & (batch.end - batch.start >= 12)
    response = (data[np.minimum(batch.start + 2, len(data) - 1)] & 0x80 > 0) & good
    counts = [np.where(good, batch.number(batch.start + 4 + 2 * k, 2), 0) for k in range(4)]
    good &= counts[0] <= 1
    asked = np.flatnonzero(good & (counts[0] == 1))
    close, labels = _question(batch, asked)
    good[asked[close < 0]] = False
    pos = batch.start + 12
    pos[asked[close >= 0]] = close[close >= 0] + 5
    has_name = np.zeros(n, dtype=bool)
    has_name[asked[close >= 0]] = True
    total = counts[1] + counts[2] + counts[3]
    least = 5 * (counts[0] - 1) + 11 * total
    more = good & (pos < batch.end)
    good &= ~more | ((least >= 0) & (least <= batch.end - pos))
    more &= good

    edns = {c: np.zeros(n, dtype=np.int64) for c in ("udp", "version", "do", "rcode")}
    option, option_size, soa = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    records, k = _Records(), 0
    rows = np.flatnonzero(more & (total > 0))
    where = pos.copy()
    while len(rows):
        at = where[rows]
        root = (data[at] == 0) & (at < batch.end[rows])
        after, named = _read_names(batch, rows, at, with_rrs)
        fits = (after >= 0) & (batch.end[rows] - after >= 10)
        head = np.where(fits, after, 0)
        code, klass, ttl, size = (batch.number(head + o, s) for o, s in ((0, 2), (2, 2), (4, 4), (8, 2)))
        fits &= size <= batch.end[rows] - head - 10
        good[rows[~fits]] = False
        section = (k >= counts[1][rows]).astype(np.int64) + (k >= counts[1][rows] + counts[2][rows])
        closing = fits & (section == 0) & response[rows] & (k + 1 == counts[1][rows])
        soa[rows[closing]] = code[closing] == wire.TYPE_SOA
        opt = fits & (section == 2) & root & (code == wire.TYPE_OPT)
        of = rows[opt]
        edns["udp"][of], edns["rcode"][of] = klass[opt], ttl[opt] >> 24
        edns["version"][of], edns["do"][of] = ttl[opt] >> 16 & 0xFF, ttl[opt] & 0x8000
        option[of], option_size[of] = head[opt] + 10, size[opt]
        if with_rrs:
            keep = fits & ~opt & response[rows]
            records.add(named, keep, row=rows, section=section, type=code, klass=klass, ttl=ttl, at=head + 10, size=size)
        where[rows] = head + 10 + size
        k += 1
        rows = rows[fits & (k < total[rows])]

    qname_wire = _cut(data, batch.start + 12, np.where(has_name, pos - 4 - batch.start - 12, 0))
    qname_wire = pc.if_else(pa.array(has_name), qname_wire, pa.scalar(bytes(1), pa.binary()))
    qname = _names(data, asked[labels[0]], *labels[1:], n)
    number = lambda x: pa.array(x.astype(np.int32))
    fields = {
        "qname": qname, "qname_wire": qname_wire,
        "qtype": number(np.where(has_name, batch.number(np.maximum(pos - 4, 0), 2), 0)),
        "qclass": number(np.where(has_name, batch.number(np.maximum(pos - 2, 0), 2), 0)),
        "edns_udp": number(edns["udp"]), "edns_version": number(edns["version"]), "edns_do": pa.array(edns["do"] > 0),
        "ext_rcode": number(edns["rcode"]), "opt_rdata": _cut(data, option, option_size, option_size == 0), "last_soa": pa.array(soa),
        "body_error": pa.nulls(n, pa.string()),
    }
    lists, broken = _lists(batch, records, n, kind)
    fields |= lists
    good[broken] = False
    made = pa.StructArray.from_arrays([fields[f.name] for f in kind], fields=list(kind))
    return _with_rest(made, values, batch.present & ~good, ~batch.present, lambda body: _one(body, with_rrs))


def _lists(batch: Batch, records: _Records, n: int, kind: pa.StructType) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The record lists of all three sections, in order; empty ones are null."""
    row, section = records.column("row"), records.column("section")
    types, at, size = records.column("type"), records.column("at"), records.column("size")
    rdata, broken = _rdata(batch, row, types, at, size)
    element = kind.field(SECTIONS[0]).type.value_type
    columns = [records.names(batch.data), pa.array(types.astype(np.int32)), pa.array(records.column("klass").astype(np.int32)),
               pa.array(records.column("ttl")), rdata]
    whole = pa.StructArray.from_arrays(columns, fields=list(element))
    out = {}
    for number, name in enumerate(SECTIONS):
        own = np.flatnonzero(section == number)
        own = own[np.argsort(row[own], kind="stable")]
        counts = np.bincount(row[own], minlength=n)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        out[name] = pa.ListArray.from_arrays(offsets, whole.take(pa.array(own)), mask=pa.array(counts == 0))
    return out, broken


def _one(body: bytes, with_rrs: bool) -> dict:
    try:
        return wire.decode_message(body, with_rrs)
    except wire.Malformed as problem:
        return {"body_error": f"error: {problem}"}


def _with_rest(made: pa.StructArray, values: pa.Array, rest: np.ndarray, missing: np.ndarray, one: Callable[[bytes], dict]) -> pa.Array:
    """`made`, with the rows in `rest` decoded one by one and those in `missing` null."""
    left = np.flatnonzero(rest)
    if not len(left) and not missing.any():
        return made
    single = pa.array([one(v) for v in values.take(pa.array(left)).to_pylist()], type=made.type)
    place = np.arange(len(values))
    place[left] = len(values) + np.arange(len(left))
    return pa.concat_arrays([made, single]).take(pa.array(place, mask=missing))


class Fields:
    """The fields of one protobuf message per row: row, number, value or position and size, in the order in which they stand."""

    def __init__(self, batch: Batch, rows: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.batch, self.broken, parts = batch, [], []
        pos = start.copy()
        going = np.flatnonzero(pos < end)
        while len(going):
            tag, at, ok = self._varint(pos[going], end[going])
            kind = tag & 7
            ok &= np.isin(kind, (0, 1, 2, 5))
            value, after, fine = self._varint(at, end[going])
            counted = (kind == 0) | (kind == 2)
            ok &= ~counted | fine
            size = np.select([kind == 2, kind == 1, kind == 5], [value, 8, 4], 0)
            low = np.where(counted, after, at)
            ok &= (size >= 0) & (size <= end[going] - low)
            self.broken.append(rows[going[~ok]])
            going, kind, value, size, low, tag = (x[ok] for x in (going, kind, value, size, low, tag))
            value = np.where(kind == 0, value, self._little(low, np.where(kind == 2, 0, size)))
            parts.append((rows[going], tag >> 3, kind == 2, value, low, size))
            pos[going] = low + size
            going = going[pos[going] < end[going]]
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.int64)
        self.row, self.field, self.sliced, self.value, self.at, self.size = (
            np.concatenate([np.empty(0, dtype=kinds[k]), *[p[k] for p in parts]]) for k in range(6))
        self.broken = np.concatenate([np.empty(0, dtype=np.int64), *self.broken])

    def _varint(self, at: np.ndarray, end: np.ndarray):
        """(value, position behind it, whether it is whole and fits); numbers of over 62 bits count as broken."""
        value, pos, ok = np.zeros(len(at), dtype=np.int64), at.copy(), np.zeros(len(at), dtype=bool)
        going = np.arange(len(at))
        for shift in range(0, 63, 7):
            going = going[pos[going] < end[going]]
            byte = self.batch.data[pos[going]].astype(np.int64)
            value[going] |= (byte & 0x7F) << shift
            pos[going] += 1
            ok[going[byte < 0x80]] = True
            going = going[byte >= 0x80]
        return value, pos, ok & (value >= 0)

    def _little(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            byte = self.batch.data[np.minimum(at + k, len(self.batch.data) - 1)].astype(np.uint64)
            out |= np.where(k < size, byte, 0).astype(np.uint64) << np.uint64(8 * k)
        return out.view(np.int64)

    def last(self, number: int, sliced: bool, n: int):
        """(present, value or position, size, wrong) by row of the last field of this number; wrong: it is encoded the other way."""
        own = np.flatnonzero(self.field == number)
        place = np.full(n, -1)
        place[self.row[own]] = own  # of several the last stays
        present = place >= 0
        at = np.where(present, place, 0)
        if not len(self.row):
            return present, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        wrong = present & (self.sliced[at] != sliced)
        return present, np.where(present, (self.at if sliced else self.value)[at], 0), np.where(present & ~wrong, self.size[at], 0), wrong


def taps(values: pa.Array, kind: pa.StructType, names: dict[str, int], binary: tuple[str, ...], one: Callable[[bytes], dict],
         extra: int, message: int, policy: int, rule: int, action: int) -> pa.Array:
    """The wanted fields of dnstap frames; the numbers say which fields they are."""
    batch = Batch(values)
    n, every = len(values), np.arange(len(values))
    top = Fields(batch, every, batch.start, batch.end)
    left = np.zeros(n, dtype=bool)
    left[top.broken] = True

    def of(fields: Fields, number: int, sliced: bool):
        present, at, size, wrong = fields.last(number, sliced, n)
        left[wrong] = True
        return present & ~wrong, at, size

    has, at, size = of(top, message, True)
    left |= batch.present & ~has
    rows = np.flatnonzero(has & ~left)
    inner = Fields(batch, rows, at[rows], at[rows] + size[rows])
    left[inner.broken] = True
    columns = {}
    for name, number in names.items():
        present, value, length = of(inner, number, name in binary)
        if name in binary:
            columns[name] = _cut(batch.data, value, length, ~present)
        else:
            columns[name] = pa.array(value, mask=~present)
    has_extra, extra_at, extra_size = of(top, extra, True)
    has_policy, policy_at, policy_size = of(inner, policy, True)
    rows = np.flatnonzero(has_policy & ~left)
    rules = Fields(batch, rows, policy_at[rows], policy_at[rows] + policy_size[rows])
    left[rules.broken] = True
    has_action, action_value, _ = of(rules, action, False)
    has_rule, rule_at, rule_size = of(rules, rule, True)
    columns |= {
        "extra": _text(_cut(batch.data, extra_at, extra_size)), "policy": pa.array(has_policy),
        "action": pa.array(action_value.astype(np.int32), mask=~has_action), "rule": _text(_cut(batch.data, rule_at, rule_size, ~has_rule)),
        "frame_error": pa.nulls(n, pa.string()),
    }
    made = pa.StructArray.from_arrays([columns[f.name] for f in kind], fields=list(kind))
    return _with_rest(made, values, left & batch.present, ~batch.present, one)
