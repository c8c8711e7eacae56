"""FASTQ as a Spark data source.

Four-line records cannot be cut at a separator, since quality lines may begin with
any character. Plain files are planned as byte ranges; each task starts at the
first complete record inside its range. Compressed files are one range each.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "sequence_id string, description string, seq string, quality string, source_file string"

    def reader(self, schema):
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.max_split = int(options.get("maxSplit", 128 << 20))

    def partitions(self):
        from pyarrow import fs

        self.path = self.path.rstrip("/")
        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        else:
            files = [info]
        # object stores name their files with the bucket, others by the path on the same server
        prefix = self.path[: len(self.path) - len(root.rstrip("/"))] if self.path.rstrip("/").endswith(root.rstrip("/")) else self.path.split("://")[0] + "://"
        out = []
        for f in sorted(files, key=lambda f: f.path):
            name = prefix + f.path
            if f.base_name.endswith(".gz"):
                out.append(_Range(name, 0, None))
            else:
                out += [
                    _Range(name, s, min(s + self.max_split, f.size))
                    for s in range(0, f.size, self.max_split)
                ]
        return out or [_Range("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        system, name = _filesystem(part.path)
        if part.stop is None:
            with system.open_input_stream(name, compression="gzip") as stream:
                yield from _batches(stream, b"", 0, None, part.path)
            return
        with system.open_input_file(name) as handle:
            if part.start == 0:
                yield from _batches(handle, b"", 0, part.stop, part.path)
                return
            handle.seek(part.start - 1)
            found = _first_record(handle)
            if found is not None:
                skipped, rest = found
                yield from _batches(handle, rest, part.start - 1 + skipped, part.stop, part.path)


BLOCK = 4 << 20


def _first_record(handle) -> tuple[int, bytes] | None:
    """Bytes up to the first record head after a line end, and what was read from there on.

    A head is a line with '@', with '+' two lines on, and equal sequence and quality lengths.
    """
    buffer, at, ended = b"", -1, False
    while True:
        more = handle.read(BLOCK)
        ended = not more
        buffer += more
        at = buffer.find(b"\n") + 1 if at < 0 else at
        while at > 0:
            ends = [at]
            while len(ends) < 5 and (cut := buffer.find(b"\n", ends[-1])) >= 0:
                ends.append(cut + 1)
            if len(ends) == 4 and ended and ends[-1] < len(buffer):
                ends.append(len(buffer))  # the last line of the file has no end
            if len(ends) < 5:
                break
            head, seq, plus, quality = (buffer[a:b].rstrip(b"\r\n") for a, b in zip(ends[:-1], ends[1:], strict=True))
            if head.startswith(b"@") and plus.startswith(b"+") and len(seq.rstrip()) == len(quality):
                return at, buffer[at:]
            at = ends[1]
        if ended:
            return None


def _batches(stream, rest: bytes, at: int, stop: int | None, path: str):
    """Arrow batches of the records that start before `stop`; `at` is the offset of `rest`."""
    import numpy as np
    import pyarrow as pa

    ended = False
    while not ended and (stop is None or at < stop):
        more = stream.read(BLOCK)
        ended = not more
        buffer = rest + more
        if ended and buffer and not buffer.endswith(b"\n"):
            buffer += b"\n"
        lines = buffer.split(b"\n")[:-1]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        begins = at + np.cumsum(sizes) - sizes
        if any(not h.startswith(b"@") for h in lines[::4]):  # blank lines between records
            keep, i = [], 0
            while i < len(lines):
                if lines[i].strip():
                    keep += range(i, min(i + 4, len(lines)))
                    i += 4
                else:
                    i += 1
            lines, begins, sizes = [lines[i] for i in keep], begins[keep], sizes[keep]
        full = len(lines) // 4 * 4
        if ended and full < len(lines):
            raise ValueError(f"{path}: the last record is cut off")
        used = int(begins[full]) - at if full < len(lines) else len(buffer) if ended or not lines or buffer.endswith(b"\n") else int(begins[-1] + sizes[-1]) - at
        n = full if stop is None else 4 * int(np.searchsorted(begins[:full:4], stop))
        rest, at = buffer[used:], at + used
        if n:
            heads = [h[1:].decode("utf-8", "replace").strip() for h in lines[:n:4]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h.split(" ", 1)[0] for h in heads], pa.string()),
                    pa.array(heads, pa.string()),
                    pa.array([s.decode("ascii", "replace").strip().replace("\ufffd", "N") for s in lines[1:n:4]], pa.string()),
                    pa.array([q.decode("latin-1").rstrip("\r") for q in lines[3:n:4]], pa.string()),
                    pa.array([path] * len(heads), pa.string()),
                ],
                names=["sequence_id", "description", "seq", "quality", "source_file"],
            )
        if stop is not None and n < full:
            return
