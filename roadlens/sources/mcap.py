"""A Spark data source for trajectory logs in MCAP files: format("trajectory_log").

Records are read by the public MCAP layout; protobuf messages are decoded with the descriptors that
the file itself carries, so no generated code is needed. Option `table` picks samples (default),
header, lights or map; header and map stop at their first message.

A log is read a chunk at a time, so memory holds one chunk. Logs over SPLIT bytes are dealt by runs of
chunks to several tasks, where their summary lists all chunks and messages; msg_seq goes on from the
messages of the chunks before. Other logs are one task each."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x89MCAP0\r\n"
TRACKS, MAP = "ground_truth", "ground_truth_map"
SPLIT = 128 << 20  # bytes of a log, and of the chunks of a task once unpacked
BATCH = 8192  # rows
_XYZ = ", ".join(f"{p}{a} double" for p in ("", "vel_", "acc_") for a in "xyz")
SCHEMAS = {
    "samples": f"file string, msg_seq long, obj_seq int, total_nanos long, idx long, {_XYZ}, length double, width double, height double, roll double, pitch double, yaw double, type int, subtype int, role int, offset_x double, offset_y double, offset_yaw double",
    "header": "file string, country_code string, proj_string string, host_vehicle_id long, version struct<major: int, minor: int, patch: int>",
    "lights": "file string, msg_seq long, total_nanos long, color int, mode int, icon int",
    "map": "file string, xml string",
}


def _string(b: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", b, at)
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(b: memoryview | bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    while at + 9 <= end:
        op, n = b[at], struct.unpack_from("<Q", b, at + 1)[0]
        yield op, bytes(b[at + 9 : at + 9 + n])
        at += 9 + n


def _chunk(body: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", body, 16)
    kind, at = _string(body, 28)
    (n,) = struct.unpack_from("<Q", body, at)
    data = body[at + 8 : at + 8 + n]
    if not kind:
        return data
    import pyarrow as pa

    return pa.Codec({"lz4": "lz4", "zstd": "zstd"}[kind]).decompress(data, decompressed_size=size).to_pybytes()


class Channels:
    """The schemas and channels that records tell of."""

    def __init__(self):
        self.schemas: dict[int, tuple[str, bytes]] = {}
        self.topics: dict[int, tuple[int, str]] = {}

    def learn(self, op: int, body: bytes) -> None:
        if op == 0x03:
            name, k = _string(body, 2)
            _, k = _string(body, k)
            (n,) = struct.unpack_from("<I", body, k)
            self.schemas[struct.unpack_from("<H", body)[0]] = (name, body[k + 4 : k + 4 + n])
        elif op == 0x04:
            topic, _ = _string(body, 4)
            self.topics[struct.unpack_from("<H", body)[0]] = (struct.unpack_from("<H", body, 2)[0], topic)

    def messages(self, records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, str, bytes, bytes]]:
        """(topic, message type, descriptor set, payload) of every message in order."""
        for op, body in records:
            if op == 0x05:
                schema, topic = self.topics[struct.unpack_from("<H", body)[0]]
                yield topic, *self.schemas.get(schema, ("", b"")), body[22:]
            elif op == 0x06:
                data = _chunk(body)
                yield from self.messages(_records(data, 0, len(data)))
            elif op in (0x02, 0x0F):
                return
            else:
                self.learn(op, body)


def _streamed(f) -> Iterator[tuple[int, bytes]]:
    """The records of a log from its beginning, one at a time; bodies nobody reads come empty."""
    if f.read(8) != MAGIC:
        raise ValueError("not an MCAP file")
    while len(head := f.read(9)) == 9:
        op, n = head[0], struct.unpack_from("<Q", head, 1)[0]
        if op in (0x03, 0x04, 0x05, 0x06):
            yield op, f.read(n)
        else:
            yield op, b""
            while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
                n -= got


@dataclass
class Chunk:
    at: int
    size: int
    unpacked: int
    index: int  # bytes of message indexes behind it
    channels: set[int]


def _summary(f, size: int) -> tuple[Channels, list[Chunk], dict[int, int]] | None:
    """The channels, chunks in file order and message counts by channel that the summary of a log tells."""
    if size < 45:
        return None
    f.seek(size - 37)
    foot = f.read(37)
    start = struct.unpack_from("<Q", foot, 9)[0]
    if foot[0] != 0x02 or foot[29:] != MAGIC or not 0 < start < size:
        return None
    f.seek(start)
    channels, chunks, counts = Channels(), [], {}
    raw = f.read(size - 37 - start)
    for op, body in _records(raw, 0, len(raw)):
        if op == 0x08:
            at, length, n = struct.unpack_from("<QQI", body, 16)
            (index,) = struct.unpack_from("<Q", body, 36 + n)
            _, k = _string(body, 44 + n)
            chunks.append(Chunk(at, length, struct.unpack_from("<Q", body, k + 8)[0], index, {c for c, _ in struct.iter_unpack("<HQ", body[36 : 36 + n])}))
        elif op == 0x0B:
            (n,) = struct.unpack_from("<I", body, 42)
            counts = dict(struct.iter_unpack("<HQ", body[46 : 46 + n]))
        else:
            channels.learn(op, body)
    return channels, sorted(chunks, key=lambda c: c.at), counts


def _counted(f, chunk: Chunk, wanted: set[int]) -> int:
    """How many messages of the wanted channels a chunk has, by its indexes."""
    f.seek(chunk.at + chunk.size)
    raw = f.read(chunk.index)
    return sum(struct.unpack_from("<I", body, 2)[0] // 16 for op, body in _records(raw, 0, len(raw)) if op == 0x07 and struct.unpack_from("<H", body)[0] in wanted)


class Decoder:
    """Messages by the descriptors in the file."""

    def __init__(self):
        self.classes: dict[tuple[str, int], type] = {}

    def __call__(self, name: str, descriptors: bytes, payload: bytes):
        key = (name, hash(descriptors))
        if key not in self.classes:
            from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

            pool = descriptor_pool.DescriptorPool()
            files = descriptor_pb2.FileDescriptorSet.FromString(descriptors).file
            left = list(files)
            while left:  # files may come before what they import
                done = {f.name for f in files} - {f.name for f in left}
                ready = [f for f in left if all(d in done or d not in {x.name for x in files} for d in f.dependency)]
                for f in ready or left:
                    pool.Add(f)
                left = [f for f in left if f not in ready] if ready else []
            self.classes[key] = message_factory.GetMessageClass(pool.FindMessageTypeByName(name))
        return self.classes[key].FromString(payload)


def _has(m, field: str):
    f = m.DESCRIPTOR.fields_by_name.get(field)
    if f is None:
        return None
    if f.has_presence and not m.HasField(field):
        return None
    return getattr(m, field)


def _path(m, *fields, default=None):
    for f in fields:
        m = _has(m, f) if m is not None else None
    return default if m is None else m


def _nanos(m) -> int:
    return int(_path(m, "timestamp", "seconds", default=0)) * 1_000_000_000 + int(_path(m, "timestamp", "nanos", default=0))


def _samples(file, seq, m):
    t = _nanos(m)
    off = [float(_path(m, "proj_frame_offset", *p, default=0.0)) for p in (("position", "x"), ("position", "y"), ("yaw",))]
    for k, o in enumerate(m.moving_object):
        num = lambda *p: float(_path(o, "base", *p, default=0.0))  # noqa: B023, E731
        xyz = [num(g, a) for g in ("position", "velocity", "acceleration") for a in "xyz"]
        size, turn = [num("dimension", a) for a in ("length", "width", "height")], [num("orientation", a) for a in ("roll", "pitch", "yaw")]
        kinds = [int(_path(o, "type", default=0)), int(_path(o, "vehicle_classification", "type", default=0)), int(_path(o, "vehicle_classification", "role", default=0))]
        yield (file, seq, k, t, int(_path(o, "id", "value", default=0)), *xyz, *size, *turn, *kinds, *off)


def _header(file, m):
    code, host, v = (_path(m, f) for f in ("country_code", "host_vehicle_id", "version"))
    version = None if v is None else tuple(int(_path(v, f"version_{p}", default=0)) for p in ("major", "minor", "patch"))
    return file, None if code is None else str(code), _path(m, "proj_string"), _path(host, "value") if host is not None else None, version


def _lights(file, seq, m):
    for light in _path(m, "traffic_light", default=[]):
        yield (file, seq, _nanos(m), *(int(_path(light, "classification", f, default=0)) for f in ("color", "mode", "icon")))


def _located(file: str):
    """(file system, path there) of a path or URI."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(file) if "://" in file or file.startswith("file:") else (pafs.LocalFileSystem(), file)


def files_of(paths: str) -> list[str]:
    """The logs that a list of paths, divided by commas, stands for: files as they are; folders by the
    *.mcap files in and below them; patterns (* ? [..]) by the files they match below their folder."""
    import fnmatch

    import pyarrow.fs as pafs

    out: list[str] = []
    for path in filter(None, paths.split(",")):
        parts = path.split("/")
        first = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[")), None)
        folder = "/".join(parts[:first]) or ("/" if path.startswith("/") else ".") if first is not None else path
        fs, at = _located(folder)
        if first is None and fs.get_file_info(at).type != pafs.FileType.Directory:
            out.append(path)
            continue
        pattern = f"{at.rstrip('/')}/{'/'.join(parts[first:])}" if first is not None else "*.mcap"
        lead = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        depth = pattern.count("/")
        out += sorted(lead + f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.path, pattern) and (first is None or f.path.count("/") == depth))
    return out


class _Part(InputPartition):
    """A whole log, or the chunks of one that lie at (offset, size); seq: messages before them."""

    def __init__(self, file: str, chunks: list[tuple[int, int]] | None = None, seq: int = 0):
        super().__init__(file)
        self.file, self.chunks, self.seq = file, chunks, seq


def _parts(file: str, table: str) -> list[_Part]:
    """The tasks of a log: several for a large one whose summary accounts for every message."""
    fs, path = _located(file)
    size = fs.get_file_info(path).size
    if table not in ("samples", "lights") or size is None or size <= SPLIT:
        return [_Part(file)]
    with fs.open_input_file(path) as f:
        channels, chunks, counts = _summary(f, size) or (Channels(), [], {})
        wanted = {c for c, (_, topic) in channels.topics.items() if topic == TRACKS}
        chunks = [c for c in chunks if c.channels & wanted]
        held = [_counted(f, c, wanted) for c in chunks]
    if not chunks or sum(held) != sum(counts.get(c, 0) for c in wanted):
        return [_Part(file)]
    out, group, weight, seq, first = [], [], 0, 0, 0
    for c, n in zip(chunks, held):
        if group and weight + c.unpacked > SPLIT:
            out.append(_Part(file, group, first))
            group, weight, first = [], 0, seq
        group, weight, seq = [*group, (c.at, c.size)], weight + c.unpacked, seq + n
    return [*out, _Part(file, group, first)]


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema):
        self.files, self.table, self.columns = files, table, schema

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(32) as pool:
            return [p for parts in pool.map(lambda f: _parts(f, self.table), self.files) for p in parts]

    def _rows(self, partition):
        file, seq, decode = partition.file, partition.seq, Decoder()
        fs, path = _located(file)
        if partition.chunks is None:
            f = fs.open_input_stream(path, buffer_size=1 << 20)
            channels, records = Channels(), _streamed(f)
        else:
            f = fs.open_input_file(path)
            channels = _summary(f, f.size())[0]
            records = (r for at, size in partition.chunks for r in _records(f.read_at(size, at), 0, size))
        with f:
            for topic, name, descriptors, payload in channels.messages(records):
                if topic != (MAP if self.table == "map" else TRACKS):
                    continue
                m = decode(name, descriptors, payload)
                if self.table == "header":
                    yield _header(file, m)
                    return
                if self.table == "map":
                    if xml := _path(m, "open_drive_xml_content") or _path(m, "map_reference"):
                        yield file, xml
                        return
                else:
                    yield from (_samples if self.table == "samples" else _lights)(file, seq, m)
                seq += 1

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.columns), self._rows(partition)
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


class TrajectoryLog(DataSource):
    """Options: path (files, folders or patterns, several by commas), table."""

    @classmethod
    def name(cls):
        return "trajectory_log"

    def _table(self):
        table = self.options.get("table", "samples")
        if table not in SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(SCHEMAS)}")
        return table

    def schema(self):
        return SCHEMAS[self._table()]

    def reader(self, schema):
        return _Reader(files_of(self.options["path"]), self._table(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrajectoryLog)


def traffic_view(samples):
    """Samples of a log as traffic trajectories: positions moved to the map's frame, subtype to
    class; all object types stay."""
    from pyspark.sql import functions as F

    from roadlens.functions.taxonomies import GROUP_OF_SUBTYPE

    group = F.create_map(*(F.lit(x) for kv in GROUP_OF_SUBTYPE.items() for x in kv))
    c, s = F.cos("offset_yaw"), F.sin("offset_yaw")
    return samples.select(
        F.col("file").alias("scene"), "total_nanos", F.col("idx").alias("id"),
        (F.col("x") * c - F.col("y") * s + F.col("offset_x")).alias("x"), (F.col("x") * s + F.col("y") * c + F.col("offset_y")).alias("y"),
        "yaw", "length", "width", F.col("vel_x").alias("vx"), F.col("vel_y").alias("vy"),
        F.coalesce(F.try_element_at(group, F.col("subtype")), F.lit("other")).alias("vclass"),
    )
