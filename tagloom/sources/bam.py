"""BAM files as a Spark data source, "bam", for reading and writing, and reads of single places in them.

Files are cut into ranges of bytes, and each task finds the first record of its range by itself. A record
belongs to the range that its first byte's block starts in. Options when reading: tags ("BX:Z,NM:i" become
columns), splits (ranges of each file; otherwise split_bytes, 32 MB unless given, sets them), fields ("core"
leaves SEQ, QUAL and tags undecoded), view ("chunks" gives CHUNKS instead of records). `fetched` reads given places or ranges alone. Option when writing:
references, as JSON [[name, length], ...], or header, the SAM header text; without either the names that
occur are used, with length 0.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import tags as tag_functions
from . import bgzf, schema, store

#: Fixed values of the format.
MAGIC, BASES, OPERATIONS, PLACED = b"BAM\1", "=ACMGRSVTWYHKDBN", "MIDNSHP=XB", "MDN=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
WIDTH = {k: struct.calcsize("<" + v) for k, v in NUMBERS.items()}
HEX_BASES = str.maketrans("0123456789abcdef", BASES)
PHRED = bytes(min(b + 33, 255) for b in range(256))
#: Bytes of a file's range, records and bytes of a batch, records that have to follow a supposed first one, and bytes of a file that one task looks places up in.
SPLIT, ROWS, BYTES, CHAIN, NEAR = 32 << 20, 4096, 8 << 20, 8, 22
#: Neighbouring records of a bin: where they stand, the smallest pos and the largest end, and how many there are. The bytes of a file that they may reach over.
CHUNKS, CHUNK = "file string, rname string, bin int, start bigint, stop bigint, low bigint, high bigint, n bigint", 1 << 18


def is_bam(path: str) -> bool:
    """Whether files are there and the unpacked content of the first starts as a BAM file's does."""
    try:
        with store.opened(files(path)[0]) as f:
            return bgzf.Reader(f).read(4) == MAGIC
    except (OSError, ValueError):
        return False


def files(path: str) -> list[str]:
    """The BAM files of comma-separated paths: files, folders or patterns."""
    out = [f for p in path.split(",") for f in store.listed(p, ".bam")]
    if not out:
        raise FileNotFoundError(f"no BAM file: {path}")
    return out


def header(reader: bgzf.Reader) -> tuple[str, list[tuple[str, int]]]:
    """The header text and the references (name, length)."""
    if reader.read(4) != MAGIC:
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", reader.read(4))[0]
    text = reader.read(number()).rstrip(b"\0").decode()
    return text, [(reader.read(number())[:-1].decode(), number()) for _ in range(number())]


def decoded_tags(data: bytes) -> dict[str, tuple]:
    """tag -> (type, integer, float, string, integers, floats)."""
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind, at = data[at : at + 2].decode("latin-1"), chr(data[at + 2]), at + 3
        if kind in NUMBERS:
            form = "<" + NUMBERS[kind]
            v = struct.unpack_from(form, data, at)[0]
            at += struct.calcsize(form)
            out[tag] = (kind, None, v, None, None, None) if kind in "fd" else (kind, v, None, None, None, None)
        elif kind == "A":
            out[tag] = (kind, None, None, chr(data[at]), None, None)
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[tag] = (kind, None, None, data[at:end].decode("utf-8", "replace"), None, None)
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            v = list(struct.unpack_from(f"<{n}{NUMBERS[sub]}", data, at + 5))
            at += 5 + n * struct.calcsize("<" + NUMBERS[sub])
            out[tag] = ("B" + sub, None, None, None, None, v) if sub == "f" else ("B" + sub, None, None, None, v, None)
        else:
            raise ValueError(f"tag {tag} has the unknown type {kind!r}")
    return out


def decoded(body: bytes, names: list[str], core_only: bool = False) -> tuple:
    """A record's columns up to qual, and its tags."""
    ref, pos, l_name, mapq, _, n_op, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    if max(ref, mate) >= len(names):
        raise ValueError("a record names an unknown reference")
    at = 32 + l_name
    qname = body[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_op}I", body, at)
    at += 4 * n_op
    seq_at, qual_at, tags_at = at, at + (l_seq + 1) // 2, at + (l_seq + 1) // 2 + l_seq
    if l_seq < 0 or tags_at > len(body):
        raise ValueError(f"record {qname} is cut short")
    found = {} if core_only else decoded_tags(body[tags_at:])
    if len(ops) == 2 and ops[0] & 15 == 4 and ops[0] >> 4 == l_seq and ops[1] & 15 == 3 and found.get("CG", ("",))[0] == "BI":
        ops = found.pop("CG")[4]  # a longer list of operations than the fixed field holds
    cigar = "".join(f"{v >> 4}{OPERATIONS[v & 15]}" for v in ops) or "*"
    seq = qual = "*"
    if not core_only and l_seq:
        seq = body[seq_at:qual_at].hex().translate(HEX_BASES)[:l_seq]
        if body[qual_at] != 0xFF:
            qual = body[qual_at:tags_at].translate(PHRED).decode("latin-1")
    rname = names[ref] if ref >= 0 else "*"
    rnext = "*" if mate < 0 else "=" if mate == ref else names[mate]
    return qname, flag, rname, pos, mapq, cigar, rnext, mate_pos + 1, tlen, seq, qual, found


def valid_tags(data: bytes, at: int, end: int) -> bool:
    """Whether tags fill the bytes up to an end."""
    while at + 3 < end:
        kind = chr(data[at + 2])
        if not (65 <= data[at] & 0xDF <= 90 and 48 <= data[at + 1] <= 122):
            return False
        at += 3
        if kind in WIDTH:
            at += WIDTH[kind]
        elif kind == "A":
            at += 1
        elif kind in "ZH":
            at = data.find(0, at, end) + 1
            if not at:
                return False
        elif kind == "B" and at + 5 <= end and chr(data[at]) in WIDTH:
            at += 5 + struct.unpack_from("<I", data, at + 1)[0] * WIDTH[chr(data[at])]
        else:
            return False
    return at == end


def record_end(data: bytes, at: int, n_references: int) -> int | None:
    """Where the record at a place ends; 0 if there is none, None if that takes more data."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_op, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (33 <= size < 1 << 30 and -1 <= ref < n_references and -1 <= mate < n_references and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
        return 0
    ops, seq, end = at + 36 + l_name, at + 36 + l_name + 4 * n_op, at + 4 + size
    aux = seq + (l_seq + 1) // 2 + l_seq
    if aux > end:
        return 0
    if seq > len(data):
        return None
    name = data[at + 36 : ops]
    if name[-1] or min(name[:-1], default=33) < 33 or any(v & 15 > 9 for v in struct.unpack_from(f"<{n_op}I", data, ops)):
        return 0
    return None if end > len(data) else end if valid_tags(data, aux, end) else 0


def first_record(file, start: int, n_references: int, end: int) -> int | None:
    """The virtual offset of the first record whose first byte is in a block from a byte on; None if there is none.

    A place counts as a record's start if all parts of a record fit there, down to its tags, and records
    follow it, up to the file's end or CHAIN of them.
    """
    at, data, ends = bgzf.first_block(file, start, end), bytearray(), []

    def more() -> bool:
        nonlocal at
        found = bgzf.block(file, at) if at < end else None
        if found:
            ends.append((len(data), at))
            data.extend(found[0])
            at = found[1]
        return found is not None

    def chained(u: int) -> bool:
        for _ in range(CHAIN):
            while (behind := record_end(data, u, n_references)) is None:
                if not more():
                    return u == len(data)
            if not behind:
                return False
            u = behind
        return True

    k = 0
    while k < len(ends) or more():
        low, address = ends[k]
        while len(data) < low + (1 << 16) + 36 and more():
            pass
        high = ends[k + 1][0] if k + 1 < len(ends) else len(data)
        wide = np.frombuffer(bytes(data[low : high + 36]), np.uint8).astype(np.int64)
        n = min(high - low, len(wide) - 35)
        if n > 0:
            word = lambda o: (wide[o : o + n] | wide[o + 1 : o + n + 1] << 8 | wide[o + 2 : o + n + 2] << 16 | wide[o + 3 : o + n + 3] << 24).astype(np.int32)  # noqa: B023, E731
            size, ref, mate, l_seq = word(0), word(4), word(24), word(20)
            may = (size >= 33) & (ref >= -1) & (ref < n_references) & (mate >= -1) & (mate < n_references) & (l_seq >= 0) & (l_seq < size) & (wide[12 : 12 + n] > 0)
            for u in np.flatnonzero(may).tolist():
                if chained(low + u):
                    return address << 16 | u
        k += 1
    return None


def scanned(path: str, start: int = 0, stop: int | None = None, tally: Callable[[int], None] | None = None) -> Iterator[tuple[list[str], int, bytes, int]]:
    """(names, virtual offset, body, virtual offset behind) of the records that belong to a range of bytes.

    The range ends where the next one finds its first record; that a record ends just there is checked.
    """
    end = store.size(path)
    with store.opened(path) as f:
        reader = bgzf.Reader(f, 0, tally)
        names = [n for n, _ in header(reader)[1]]
        top = reader.tell()

        def begin(at: int | None) -> int | None:
            return None if at is None or at >= end else top if at <= top >> 16 else first_record(f, at, len(names), end)

        first, last = begin(start), begin(stop)
        if first is None or first == last:
            return
        reader.seek(first)
        at = first
        while last is None or at < last:
            body = next_record(reader)
            if body is None:
                at = None
                break
            behind = reader.tell()
            yield names, at, body, behind
            at = behind
        if last is not None and at != last:
            raise ValueError(f"{path}: the records before {last} don't end there")


def next_record(reader: bgzf.Reader) -> bytes | None:
    """The body of the record where a reader stands; None at the end."""
    size = reader.read(4)
    if not size:
        return None
    n = struct.unpack("<i", size)[0] if len(size) == 4 else -1
    body = reader.read(n) if n >= 32 else b""
    if n < 32 or len(body) != n:
        raise ValueError(f"a record before {reader.tell()} is cut short or damaged")
    return body


class Batches:
    """Records as Arrow batches of bounded size: the record schema, then a column for each promoted tag."""

    def __init__(self, kind, promoted: list[tuple[str, str]] = (), core: bool = False):
        self.kind, self.promoted, self.core = kind, promoted, core
        self.rows, self.size = [], 0

    def add(self, path: str, names: list[str], at: int, body: bytes):
        """A batch, if the record fills one."""
        self.rows.append((*decoded(body, names, self.core), at, path))
        self.size += len(body)
        return self.batch() if len(self.rows) >= ROWS or self.size >= BYTES else None

    def batch(self):
        import pyarrow as pa

        columns = list(zip(*self.rows, strict=True)) or [()] * 14
        self.rows, self.size = [], 0
        aux = columns[11]
        entries = [(t, *v) for x in aux for t, v in x.items()]
        parts = list(zip(*entries, strict=True)) or [()] * 7
        map_kind = self.kind.field("aux").type
        values = pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts[1:], map_kind.item_type, strict=True)], fields=list(map_kind.item_type))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in aux])]).astype(np.int32)
        tags_ = pa.MapArray.from_arrays(pa.array(offsets), pa.array(parts[0], pa.string()), values).cast(map_kind)
        out = [*columns[:11], columns[12], columns[13]]
        arrays = [pa.array(c, f.type) for c, f in zip(out, list(self.kind)[:13], strict=True)] + [tags_]
        for (tag, kind), f in zip(self.promoted, list(self.kind)[14:], strict=True):
            arrays.append(pa.array([promoted_value(x.get(tag), kind) for x in aux], f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.kind)


def promoted_value(v: tuple | None, kind: str):
    """What a tag's column of a kind holds; null where the record lacks the tag or has it with another kind of type."""
    return None if v is None else v[5 if kind[1:] == "f" else 4] if kind[0] == "B" else v["_ifs".index(tag_functions.FIELD[kind][0])]


def sql_schema(promoted: list[tuple[str, str]]) -> str:
    return schema.RECORD + "".join(f", `{t}` {field_type(k)}" for t, k in promoted)


def arrow_schema(promoted: list[tuple[str, str]]):
    return to_arrow_schema(_parse_datatype_string(sql_schema(promoted)))


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    stop: int | None = None


def parts(path: str, splits: int | None = None, split_bytes: int = SPLIT) -> list[Part]:
    """The ranges of bytes that files are read in; no file is opened for that."""
    out = []
    for p in files(path):
        n = store.size(p)
        step = -(-n // splits) if splits else split_bytes
        cuts = [*range(0, n, max(1, step))] or [0]
        out += [Part(p, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return out


def chunks(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows of CHUNKS: neighbouring records of a range of bytes that have the same bin, as long as they stand within CHUNK bytes."""
    held = None
    for names, at, body, behind in scanned(path, start, stop):
        ref, pos, l_name, _, _, n_op = struct.unpack_from("<iiBBHH", body)
        flag = struct.unpack_from("<H", body, 14)[0]
        ops = struct.unpack_from(f"<{n_op}I", body, 32 + l_name)
        if n_op == 2 and ops[0] & 15 == 4 and ops[1] & 15 == 3:  # the place of a longer list of operations
            span = ops[1] >> 4
        else:
            span = sum(v >> 4 for v in ops if OPERATIONS[v & 15] in PLACED)
        end = pos + (1 if flag & 4 or not span else span)
        rname, number = names[ref] if ref >= 0 else "*", bin_of(pos, end) if pos >= 0 else 4680
        if held and (held[1], held[2]) == (rname, number) and (at >> 16) - (held[3] >> 16) < CHUNK:
            held[4:] = [behind, min(held[5], pos), max(held[6], end), held[7] + 1]
        else:
            if held:
                yield tuple(held)
            held = [path, rname, number, at, behind, pos, end, 1]
    if held:
        yield tuple(held)


class BamReader(DataSourceReader):
    def __init__(self, options: dict, kind: StructType):
        self.kind = to_arrow_schema(kind)
        self.view = options.get("view", "records")
        self.parts = parts(options["path"], int(options["splits"]) if "splits" in options else None, int(options.get("split_bytes", SPLIT)))
        self.core, self.tags = options.get("fields", "all") == "core", schema.promoted(options.get("tags", ""))

    def partitions(self):
        return self.parts

    def read(self, part: Part):
        if self.view == "chunks":
            yield from chunks(part.path, part.start, part.stop)
            return
        made = Batches(self.kind, self.tags, self.core)
        for names, at, body, _ in scanned(part.path, part.start, part.stop):
            if full := made.add(part.path, names, at, body):
                yield full
        yield made.batch()


def fetched(spark: SparkSession, places: DataFrame, tags: str = "", fields: str = "all", tally=None) -> DataFrame:
    """The records at places (file, voffset), or whose voffset is in ranges (file, start, stop) that don't overlap. Each place counts once.

    Places that are near each other in a file go to one task, in order, which seeks to each and inflates a
    block once. `tally` is an accumulator that counts inflated blocks.
    """
    if "voffset" in places.columns:
        places = places.select("file", F.col("voffset").alias("start"), (F.col("voffset") + 1).alias("stop"))
    promoted, core = schema.promoted(tags), fields == "core"
    kind = arrow_schema(promoted)
    near = places.select("file", "start", "stop").distinct().repartition("file", F.shiftright("start", 16 + NEAR)).sortWithinPartitions("file", "start")
    add = tally.add if tally is not None else None

    def run(batches):
        made, reader, path, f, names = Batches(kind, promoted, core), None, None, None, []
        for b in batches:
            for own, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != path:
                    if f:
                        f.close()
                    path, f = own, store.opened(own, store.SEEK)
                    reader = bgzf.Reader(f, 0, add)
                    names = [n for n, _ in header(reader)[1]]
                reader.seek(start)
                at, single = start, stop == start + 1
                while at < stop and (body := next_record(reader)) is not None:
                    if full := made.add(path, names, at, body):
                        yield full
                    at = stop if single else reader.tell()
        yield made.batch()

    return near.mapInArrow(run, sql_schema(promoted))


def field_type(kind: str) -> str:
    return ("array<double>" if kind[1:] == "f" else "array<bigint>") if kind[0] == "B" else tag_functions.FIELD[kind][1]


def smallest(v: int) -> str:
    """The narrowest integer type, unsigned from 0 on."""
    for kind, low, high in (("C", 0, 2**8), ("c", -(2**7), 0), ("S", 0, 2**16), ("s", -(2**15), 0), ("I", 0, 2**32), ("i", -(2**31), 0)):
        if low <= v < high:
            return kind
    raise ValueError(f"an integer tag is beyond 32 bits: {v}")


def encoded_tag(tag: str, v) -> bytes:
    kind, name = v["t"], tag.encode("latin-1")
    if kind[0] == "B":
        sub = kind[1:] or "i"
        items = v["fa"] if sub == "f" else v["ia"]
        return name + b"B" + sub.encode() + struct.pack(f"<I{len(items)}{NUMBERS[sub]}", len(items), *items)
    if kind in "ZH":
        return name + kind.encode() + (v["s"] or "").encode() + b"\0"
    if kind == "A":
        return name + b"A" + v["s"].encode("latin-1")[:1]
    if kind in "fd":
        return name + kind.encode() + struct.pack("<" + NUMBERS[kind], v["f"])
    kind = smallest(v["i"])
    return name + kind.encode() + struct.pack("<" + NUMBERS[kind], v["i"])


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the five-level scheme that holds [start, end)."""
    end -= 1
    for shift, level in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return level + (start >> shift)
    return 0


def encoded(row, numbers: dict[str, int]) -> bytes:
    import re

    ref = numbers.get(row["rname"], -1)
    mate = ref if row["rnext"] == "=" else numbers.get(row["rnext"], -1)
    cigar = row["cigar"] if row["cigar"] not in (None, "*") else ""
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", cigar)]
    packed = [n << 4 | OPERATIONS.index(o) for n, o in ops]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    aux = b"".join(encoded_tag(t, v) for t, v in (row["aux"] or {}).items())
    span = sum(n for n, o in ops if o in PLACED) or 1
    if len(packed) > 65535:
        aux += b"CGBI" + struct.pack(f"<I{len(packed)}I", len(packed), *packed)
        packed = [len(seq) << 4 | 4, span << 4 | 3]
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    quality = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    if len(quality) != len(seq):
        raise ValueError(f"SEQ and QUAL of {row['qname']} differ in length")
    name = row["qname"].encode() + b"\0"
    if len(name) > 252:
        raise ValueError(f"read name is too long: {row['qname']}")
    unplaced = row["flag"] & 4 or not ops
    where = bin_of(max(0, row["pos"]), max(0, row["pos"]) + (1 if unplaced else span)) if row["pos"] >= 0 else 4680
    fixed = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], where & 0xFFFF, len(packed), row["flag"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body = fixed + name + struct.pack(f"<{len(packed)}I", *packed) + bases + quality + aux
    return struct.pack("<i", len(body)) + body


def references(text: str) -> list[tuple[str, int]]:
    """The references of a SAM header; the first of repeated names counts."""
    out: dict[str, int] = {}
    for line in text.splitlines():
        if line.startswith("@SQ"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            out.setdefault(fields["SN"], int(fields.get("LN", 0)))
    return list(out.items())


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class BamWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.text = options["path"].rstrip("/"), overwrite, options.get("header", "")
        self.references = [tuple(x) for x in json.loads(options["references"])] if "references" in options else references(self.text)
        self.old = store.listed(f"{self.path}/*.bam", ".bam") if overwrite else []

    def write(self, rows):
        import shutil

        system, top = store.of(self.path)
        system.create_dir(top, recursive=True)
        name = uuid.uuid4().hex
        temporary, body = f"{top}/.{name}.tmp", f"{top}/.{name}.body"
        numbers, open_ended = {n: i for i, (n, _) in enumerate(self.references)}, not self.references
        # Blocks can follow each other, so the header is written when the names of all records are known.
        with system.open_output_stream(body) as f:
            out = bgzf.Writer(f)
            for row in rows:
                for r in (row["rname"], row["rnext"]) if open_ended else ():
                    if r not in ("*", "="):
                        numbers.setdefault(r, len(numbers))
                out.write(encoded(row, numbers))
            out.close()
        known = self.references or [(n, 0) for n in numbers]
        text = (self.text or "".join(f"@SQ\tSN:{n}\tLN:{l}\n" for n, l in known)).encode()
        with system.open_output_stream(temporary) as f, system.open_input_stream(body) as own:
            out = bgzf.Writer(f)
            out.write(MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(known)))
            for n, length in known:
                out.write(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length))
            out.flush()
            shutil.copyfileobj(own, f, 1 << 20)
        system.delete_file(body)
        return Written(temporary, f"{top}/part-{name}.bam")

    def commit(self, messages):
        system, _ = store.of(self.path)
        for m in messages:
            if m:
                system.move(m.temporary, m.final)
        for p in self.old:
            system.delete_file(store.of(p)[1])

    def abort(self, messages):
        from pyarrow import fs

        system, _ = store.of(self.path)
        for m in messages:
            if m and system.get_file_info(m.temporary).type != fs.FileType.NotFound:
                system.delete_file(m.temporary)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        if self.options.get("view") == "chunks":
            return CHUNKS
        return sql_schema(schema.promoted(self.options.get("tags", "")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BamWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """All records of files. The plan reads whole files; `fetched` is for single places."""
    register(spark)
    return spark.read.format("bam").options(**options).load(path)


def reference_names(spark: SparkSession, path: str) -> DataFrame:
    """name: each reference of the files' headers once. A task reads the headers of its files."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = {}
            for p in b.column(0).to_pylist():
                with store.opened(p, store.SEEK) as f:
                    found.update(dict.fromkeys(n for n, _ in header(bgzf.Reader(f))[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["name"])

    return spark.createDataFrame([(p,) for p in files(path)], "path string").mapInArrow(run, "name string").distinct()


def write(frame: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes a file for each partition. Without references or a header, the names that occur in all partitions are every file's references."""
    register(frame.sparkSession)
    if not {"references", "header"} & set(options):
        names = frame.select(F.explode(F.array("rname", "rnext")).alias("n")).distinct().filter("n not in ('*', '=')")
        options["references"] = json.dumps(sorted((r["n"], 0) for r in names.collect()))  # as many as a header has
    frame.select(*schema.NAMES, F.lit(None).cast("bigint").alias("voffset"), F.lit(None).cast("string").alias("file"), "aux").write.format("bam").options(**options).mode(mode).save(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files in a store that only Spark reads, a file a task and each below 2 GB."""
    import io

    kind = arrow_schema([])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made, reader = Batches(kind), bgzf.Reader(io.BytesIO(content))
                names = [n for n, _ in header(reader)[1]]
                at = reader.tell()
                while (body := next_record(reader)) is not None:
                    if full := made.add(name, names, at, body):
                        yield full
                    at = reader.tell()
                yield made.batch()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema.RECORD)
