"""Dictionary-normalised blocks: a fact table that refers to per-block dictionaries.

A block holds at most `rows_per_block` rows, so everything done per block is bounded.
Blocks are cut within time slots; a crowded slot is first divided by row id, so no
window ever orders a whole slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.functions.codes import MICROS
from dnsflow.plans.shared import shared_folder
from dnsflow.schema import RR_LIST

RECORD_SECTIONS = (
    "response_answer_sections", "response_authority_sections", "response_additional_sections",
)
# Columns that move into the signature dictionary.
SIGNATURE = (
    "server_address", "server_port", "qr_transport_flags", "qr_dns_flags", "query_ancount",
    "query_arcount", "query_nscount", "query_qdcount", "query_opcode", "response_rcode",
    "query_classtype", "query_edns_version", "query_edns_udp_size", "query_opt_data",
)
DICTIONARIES = ("names", "addresses", "classtypes", "signatures", "records", "record_lists")


def spread_id(row_id: Column) -> Column:
    """Row ids mixed by multiplication, so that ids with a regular step fill all parts alike."""
    low = F.pmod(row_id, F.lit(1 << 31))
    return F.shiftright(low * F.lit(2_654_435_761), 16)


def assign_blocks(
    rows: DataFrame,
    rows_per_block: int = 10_000,
    slot_s: int = 3600,
    rows_per_part: int = 1_000_000,
    row_id: str = "query_id",
    time_us: str = "time_offset",
) -> DataFrame:
    """Adds `block_id`; blocks have at most `rows_per_block` rows in row id order."""
    slot = F.floor(F.col(time_us) / (slot_s * MICROS)).cast("bigint")
    slotted = rows.withColumn("__slot", slot)
    # One row per time slot, so the table grows with the time span only. It is broadcast: a join by slot would
    # leave the rows dealt by slot, and the window below would take a slot in one task.
    sizes = slotted.groupBy("__slot").agg(
        F.ceil(F.count("*") / rows_per_part).cast("bigint").alias("__parts")
    )
    parted = slotted.join(F.broadcast(sizes), "__slot").withColumn(
        "__part", F.pmod(spread_id(F.col(row_id)), F.col("__parts"))
    )
    number = F.row_number().over(Window.partitionBy("__slot", "__part").orderBy(row_id)) - 1
    block = F.concat_ws(
        "-", "__slot", "__part", F.floor(number / rows_per_block).cast("string")
    )
    return parted.withColumn("block_id", block).drop("__slot", "__parts", "__part")


# Every row of the encoded table belongs to one of the tables and has its values in that table's struct.
FACTS = "facts"
RECORD_KEYS = {"name": pa.binary(), "type": pa.int32(), "class": pa.int32(), "ttl": pa.int64(), "rdata": pa.binary()}


def _struct_of(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{k}" for n, k in fields.items()) + ">"


@dataclass(frozen=True)
class _Layout:
    """Columns and types of a block's rows, its facts and its dictionaries."""

    types: dict[str, str]

    @classmethod
    def of(cls, rows: DataFrame) -> _Layout:
        return cls({f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "block_id"})

    @property
    def signature(self) -> list[str]:
        return [c for c in SIGNATURE if c in self.types]

    @property
    def sections(self) -> list[str]:
        return [c for c in RECORD_SECTIONS if c in self.types]

    @property
    def plain(self) -> list[str]:
        """Columns that stay in the facts."""
        moved = {*self.signature, *self.sections, "query_name", "client_address"}
        return [c for c in self.types if c not in moved]

    @property
    def tables(self) -> dict[str, dict[str, str]]:
        """The columns of every table besides its block and, for dictionaries, its index."""
        indexes = ["query_name_index", "client_address_index", *[f"{c}_index" for c in self.sections], "qr_signature_index"]
        moved = {"server_address": "server_address_index", "query_classtype": "query_classtype_index", "query_opt_data": "query_opt_data_index"}
        return {
            FACTS: {**{c: self.types[c] for c in self.plain}, **dict.fromkeys(indexes, "int")},
            "names": {"value": "binary"}, "addresses": {"value": "binary"}, "classtypes": {"value": "struct<type:int,class:int>"},
            "signatures": {moved.get(c, c): "int" if c in moved else self.types[c] for c in self.signature},
            "records": {"ttl": "bigint", "name_index": "int", "rdata_index": "int", "classtype_index": "int"},
            "record_lists": {"pos": "int", "record": "int"},
        }

    @property
    def tagged(self) -> str:
        return "table string, block_id string, index int, " + ", ".join(f"{t} {_struct_of(fields)}" for t, fields in self.tables.items())


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _distinct(*arrays: pa.Array) -> pa.Array:
    """The sorted distinct values of all arrays, without null."""
    values = pc.unique(pa.chunked_array([a for a in arrays])).drop_null()
    return values.take(pc.sort_indices(values))


def _at(values: pa.Array, wanted: pa.Array) -> pa.Array:
    """Where the wanted values stand among the distinct ones; null for null."""
    return pc.index_in(wanted, value_set=values).cast(pa.int32())


def _codes(array: pa.Array) -> np.ndarray:
    """A number for every value that sorts like it; -1 for null."""
    return pc.fill_null(_at(_distinct(array), array), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of codes the first of every distinct one, in the order of the codes, and which of the distinct ones each row is."""
    key = codes[0]
    for code in codes[1:]:
        key = np.unique(key * (code.max(initial=-1) + 2) + code + 1, return_inverse=True)[1].reshape(-1)
    _, first, index = np.unique(key, return_index=True, return_inverse=True)
    return first, index.reshape(-1)


def _places(block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of their blocks: the place of each within its block, and the first row of each block."""
    first = np.searchsorted(block, np.arange(blocks))
    return np.arange(len(block)) - first[block], first


def _numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each row's block, counted in the order they come, and the ids of the blocks."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _by_whole_blocks(work):
    """`work` on tables of whole blocks, many at once, of rows that come sorted by block; the last block waits for its other rows."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            block = _numbered(_whole(held, "block_id"))[0]
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield from work(held.slice(0, cut).combine_chunks()).to_batches()
                held = held.slice(cut)
        if held is not None:
            yield from work(held.combine_chunks()).to_batches()

    return run


def _mapped(rows: DataFrame, work, schema: str) -> DataFrame:
    """`work` on all blocks: one shuffle by block, then many blocks to a call."""
    return rows.repartition("block_id").sortWithinPartitions("block_id").mapInArrow(_by_whole_blocks(work), schema)


class _Dictionary:
    """The sorted distinct values of each block, from arrays of values and the blocks of their rows."""

    def __init__(self, blocks: int, *parts: tuple[np.ndarray, pa.Array]):
        self.all = _distinct(*[values for _, values in parts])
        self.held = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *[key[code >= 0] for key, code in (self._keys(*p) for p in parts)]]))
        size = max(1, len(self.all))
        self.block, self.values = self.held // size, self.all.take(pa.array(self.held % size))
        self.index = _places(self.block, blocks)[0]

    def _keys(self, block: np.ndarray, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = pc.fill_null(_at(self.all, values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return block * max(1, len(self.all)) + code, code

    def at(self, block: np.ndarray, values: pa.Array) -> pa.Array:
        """Where the values stand in the dictionaries of their blocks; null for null."""
        key, code = self._keys(block, values)
        if not len(self.held):
            return pa.nulls(len(key), pa.int32())
        place = self.index[np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)]
        return pa.array(place.astype(np.int32), mask=code < 0)


def _pairs_of(structs: pa.Array) -> pa.Array:
    """Type and class as one number that sorts like both."""
    kind, of = (pc.struct_field(structs, n).cast(pa.int64()) for n in ("type", "class"))
    return pc.add(pc.multiply(kind, 1 << 32), of)


def _encoded(layout: _Layout):
    def encode(rows: pa.Table) -> pa.Table:
        """All tables of the blocks whose rows these are."""
        column = lambda c: _whole(rows, c)
        of_row, block_ids = _numbered(column("block_id"))
        blocks = len(block_ids)
        lists = [column(c) for c in layout.sections]
        held = [x.flatten() for x in lists]
        sizes = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in lists]
        of_record = np.concatenate([np.empty(0, dtype=np.int64), *[np.repeat(of_row, np.maximum(n, 0)) for n in sizes]])
        part = {k: pa.concat_arrays([pa.array([], kind), *[pc.struct_field(x, k).cast(kind) for x in held]]) for k, kind in RECORD_KEYS.items()}
        record_class = pc.add(pc.multiply(part["type"].cast(pa.int64()), 1 << 32), part["class"].cast(pa.int64()))
        binary = lambda c: column(c).cast(pa.binary()) if c in layout.types else pa.nulls(len(of_row), pa.binary())
        query_class = _pairs_of(column("query_classtype")) if "query_classtype" in layout.types else pa.nulls(len(of_row), pa.int64())
        names = _Dictionary(
            blocks, (of_row, binary("query_name")), (of_row, binary("query_opt_data")), (of_record, part["name"]), (of_record, part["rdata"]))
        addresses = _Dictionary(blocks, (of_row, binary("client_address")), (of_row, binary("server_address")))
        classes = _Dictionary(blocks, (of_row, query_class), (of_record, record_class))

        refers = {"server_address": (addresses, binary), "query_opt_data": (names, binary), "query_classtype": (classes, lambda c: query_class)}
        signed = {c: refers[c][0].at(of_row, refers[c][1](c)) if c in refers else column(c) for c in layout.signature}
        first_signature, signature = _rows([of_row, *[_codes(a) for a in signed.values()]])
        signature_place = _places(of_row[first_signature], blocks)[0]

        first_record, record = _rows([of_record, *[_codes(x) for x in part.values()]])
        of_first = of_record[first_record]
        record_place = _places(of_first, blocks)[0]
        members: dict[tuple[int, bytes], int] = {}  # distinct lists of every block, by their records
        found = [0] * blocks
        list_index, at, numbers = {}, 0, of_row.tolist()
        for name, of_list in zip(layout.sections, sizes):
            index = [None] * len(numbers)
            for row in np.flatnonzero(of_list >= 0).tolist():
                size, block = int(of_list[row]), numbers[row]
                key = (block, record[at : at + size].tobytes())
                place = members.get(key)
                if place is None:
                    place = members[key] = found[block]
                    found[block] += 1
                index[row] = place
                at += size
            list_index[name] = pa.array(index, pa.int32())
        spread = [np.frombuffer(x, dtype=np.int64) for _, x in members]
        lengths = np.array([len(x) for x in spread], dtype=np.int64)
        positions = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        listed = np.concatenate([np.empty(0, dtype=np.int64), *spread])
        of_listed = np.repeat(np.array([block for block, _ in members], dtype=np.int64), lengths)

        number = lambda values: pa.array(np.asarray(values, dtype=np.int32))
        indexes = [names.at(of_row, binary("query_name")), addresses.at(of_row, binary("client_address")), *list_index.values(), number(signature_place[signature])]
        classtype = [pc.shift_right(classes.values, 32).cast(pa.int32()), pc.bit_wise_and(classes.values, 0xFFFFFFFF).cast(pa.int32())]
        at_first = lambda dictionary, values: dictionary.at(of_first, values.take(pa.array(first_record)))
        made = {
            FACTS: (of_row, None, [*[column(c) for c in layout.plain], *indexes]),
            "names": (names.block, names.index, [names.values]), "addresses": (addresses.block, addresses.index, [addresses.values]),
            "classtypes": (classes.block, classes.index, [pa.StructArray.from_arrays(classtype, ["type", "class"])]),
            "signatures": (of_row[first_signature], signature_place, [a.take(pa.array(first_signature)) for a in signed.values()]),
            "records": (of_first, record_place, [
                part["ttl"].take(pa.array(first_record)).cast(pa.int64()),
                at_first(names, part["name"]), at_first(names, part["rdata"]), at_first(classes, record_class)]),
            "record_lists": (of_listed, np.repeat(np.array(list(members.values()), dtype=np.int64), lengths), [number(positions), number(record_place[listed])]),
        }
        kinds = {t: pa.struct([(c, v.type) for c, v in zip(layout.tables[t], values)]) for t, (*_, values) in made.items()}
        tables = []
        for name, (block, index, values) in made.items():
            structs = pa.StructArray.from_arrays(values, fields=list(kinds[name]))
            index = pa.nulls(len(structs), pa.int32()) if index is None else number(index)
            fixed = [pa.array([name] * len(structs), pa.string()), block_ids.take(pa.array(block)), index]
            others = [structs if t == name else pa.nulls(len(structs), kinds[t]) for t in kinds]
            tables.append(pa.table([*fixed, *others], names=["table", "block_id", "index", *kinds]))
        return pa.concat_tables(tables)

    return encode


def encode_blocks(rows: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The facts and the six dictionaries (block_id, index, value...) of rows with a `block_id`.

    Rows are shuffled once, by block. Blocks, whose size is bounded, become the rows of all seven tables, many blocks
    in one call; these are written to the shared folder by table.
    """
    layout = _Layout.of(rows)
    encoded = _mapped(rows, _encoded(layout), layout.tagged)
    folder = shared_folder(rows.sparkSession, "encoded")
    encoded.write.partitionBy("table").parquet(folder)
    back = rows.sparkSession.read.schema(encoded.schema).parquet(folder)
    tables = {}
    for name in layout.tables:
        index = [] if name == FACTS else ["index"]
        tables[name] = back.filter(F.col("table") == name).select("block_id", *index, f"{name}.*")
    return tables.pop(FACTS), tables


def _decoded(layout: _Layout, names: list[str]):
    def decode(rows: pa.Table) -> pa.Table:
        """The rows of the blocks whose tables these are."""
        table = _whole(rows, "table")
        numbers, block_ids = _numbered(_whole(rows, "block_id"))
        blocks = len(block_ids)

        def rows_of(name: str, *more: str) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
            """Block, first row of each block and columns of a table, in the order of blocks, of indexes and of further columns."""
            mine = pc.equal(table, name)
            kept, block = rows.filter(mine), numbers[mine.to_numpy(zero_copy_only=False)]
            values = {c: pc.struct_field(_whole(kept, name), c) for c in layout.tables[name]}
            values["index"] = _whole(kept, "index")
            if name != FACTS:
                order = np.lexsort((*[values[c].to_numpy() for c in more], values["index"].to_numpy(), block))
                block, values = block[order], {c: v.take(pa.array(order)) for c, v in values.items()}
            return block, np.searchsorted(block, np.arange(blocks)), values

        def among(first: np.ndarray, block: np.ndarray, index: pa.Array) -> pa.Array:
            """Rows of a table that indexes within blocks stand for; null for null."""
            return pc.add(index.cast(pa.int64()), pa.array(first[block]))

        of_fact, _, facts = rows_of(FACTS)
        first, value = {}, {}
        for name in ("names", "addresses", "classtypes"):
            _, first[name], found = rows_of(name)
            value[name] = found["value"]
        at = lambda name, block, index: value[name].take(among(first[name], block, index))
        of_record, first_record, records = rows_of("records")
        of_signature, first_signature, signatures = rows_of("signatures")
        of_member, _, members = rows_of("record_lists", "pos")
        kind = at("classtypes", of_record, records["classtype_index"])
        rr = pa.StructArray.from_arrays(
            [at("names", of_record, records["name_index"]).cast(pa.string()), *[pc.struct_field(kind, k) for k in ("type", "class")],
             records["ttl"], at("names", of_record, records["rdata_index"]).cast(pa.string())], list(RECORD_KEYS))
        wanted = {c: facts[f"{c}_index"] for c in layout.sections}
        number = members["index"].to_numpy()
        n_lists = np.zeros(blocks, dtype=np.int64)  # empty lists have no rows
        for block, index in [(of_member, number), *[(of_fact, pc.fill_null(w, -1).to_numpy(zero_copy_only=False)) for w in wanted.values()]]:
            np.maximum.at(n_lists, block, index.astype(np.int64) + 1)
        first_list = np.cumsum(n_lists) - n_lists
        sizes = np.bincount(first_list[of_member] + number, minlength=n_lists.sum()).astype(np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, rr.take(among(first_record, of_member, members["record"])), mask=pa.array(sizes == 0))
        signature = among(first_signature, of_fact, facts["qr_signature_index"])
        refers = {"server_address": "addresses", "query_classtype": "classtypes", "query_opt_data": "names"}
        signed = {c: at(refers[c], of_signature, signatures[f"{c}_index"]) if c in refers else signatures[c] for c in layout.signature}
        out = {
            "query_name": lambda: at("names", of_fact, facts["query_name_index"]).cast(pa.string()),
            "client_address": lambda: at("addresses", of_fact, facts["client_address_index"]),
            **{c: lambda c=c: lists.take(among(first_list, of_fact, wanted[c])) for c in layout.sections},
            **{c: lambda c=c: signed[c].take(signature) for c in layout.signature},
        }
        return pa.table([block_ids.take(pa.array(of_fact)), *[out[c]() if c in out else facts[c] for c in names]], names=["block_id", *names])

    return decode


def decode_refs(facts: DataFrame, dicts: dict[str, DataFrame]) -> DataFrame:
    """Rebuilds the rows `encode_blocks` was given, in one shuffle by block. Empty record lists become null."""
    fields = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in ("block_id", "index")}
    of_signature = fields(dicts["signatures"])
    moved = {"server_address": "binary", "query_classtype": "struct<type:int,class:int>", "query_opt_data": "binary"}
    types = {c: k for c, k in fields(facts).items() if not c.endswith("_index")}
    types |= {"query_name": "string", "client_address": "binary"}
    types |= {c: moved.get(c, of_signature.get(c)) for c in SIGNATURE if c in of_signature or f"{c}_index" in of_signature}
    types |= {c: RR_LIST for c in RECORD_SECTIONS if f"{c}_index" in facts.columns}
    layout = _Layout(types)
    tagged = None
    for name, columns in layout.tables.items():
        df = facts if name == FACTS else dicts[name]
        index = F.lit(None).cast("int") if name == FACTS else F.col("index").cast("int")
        own = F.struct(*[F.col(c).cast(k).alias(c) for c, k in columns.items()])
        others = [own.alias(t) if t == name else F.lit(None).cast(_struct_of(c)).alias(t) for t, c in layout.tables.items()]
        rows = df.select(F.lit(name).alias("table"), "block_id", index.alias("index"), *others)
        tagged = rows if tagged is None else tagged.unionByName(rows)
    schema = "block_id string, " + ", ".join(f"`{c}` {k}" for c, k in types.items())
    return _mapped(tagged, _decoded(layout, list(types)), schema)
