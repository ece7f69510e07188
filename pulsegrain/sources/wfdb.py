"""WFDB records as a Spark data source: one partition per record, sample ranges read by seeking.

    spark.dataSource.register(WfdbSource)
    spark.read.format("wfdb").option("records", "a/r1,a/r2").option("root", "/data").option("sampfrom", 0).option("sampto", 5000).load()

Signals of format 16 and 212 and beat annotations of the usual binary form are read with numpy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record string, fs double, n_samples long, sample_start long, sample_end long, leads array<string>, signals array<array<double>>, beats array<struct<sample:bigint,symbol:string>>, notes array<struct<sample:bigint,note:string>>"
#: Codes of the annotation format.
SYMBOLS = {1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 28: "+", 34: "e", 38: "f"}
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63


def read_header(path: Path) -> dict:
    """Record line and signal lines of a header file."""
    lines = [line for line in path.read_text().splitlines() if line.strip() and not line.startswith("#")]
    first = lines[0].split()
    signals = []
    for line in lines[1 : 1 + int(first[1])]:
        cell = line.split()
        gain = cell[2].split("/")[0] if len(cell) > 2 else "200"
        value, _, base = gain.partition("(")
        signals.append({"file": cell[0], "format": int(cell[1].split("x")[0].split(":")[0].split("+")[0]), "gain": float(value) or 200.0, "baseline": int(base[:-1]) if base else int(cell[4]) if len(cell) > 4 else 0, "name": " ".join(cell[8:]) or f"sig{len(signals)}"})
    return {"name": first[0], "fs": float(first[2].split("/")[0]) if len(first) > 2 else 250.0, "n": int(first[3]) if len(first) > 3 else None, "signals": signals}


def read_signals(folder: Path, header: dict, start: int, end: int) -> list[np.ndarray]:
    """Physical values of [start, end); only the bytes of that range are read."""
    specs = header["signals"]
    width = len(specs)
    path = folder / specs[0]["file"]
    if specs[0]["format"] == 16:
        with path.open("rb") as f:
            f.seek(2 * width * start)
            raw = np.frombuffer(f.read(2 * width * (end - start)), "<i2").astype(int)
    elif specs[0]["format"] == 212:
        first, last = start * width, end * width
        with path.open("rb") as f:
            f.seek(first // 2 * 3)
            data = np.frombuffer(f.read((last + 1) // 2 * 3 - first // 2 * 3), np.uint8).astype(int)
        data = data[: len(data) // 3 * 3].reshape(-1, 3)
        pair = np.stack([data[:, 0] | (data[:, 1] & 0x0F) << 8, data[:, 2] | (data[:, 1] & 0xF0) << 4], axis=1).ravel()
        pair = np.where(pair > 2047, pair - 4096, pair)
        raw = pair[first % 2 : first % 2 + last - first]
    else:
        raise ValueError(f"signal format {specs[0]['format']} is not supported")
    raw = raw[: len(raw) // width * width].reshape(-1, width)
    return [(raw[:, k] - s["baseline"]) / s["gain"] for k, s in enumerate(specs)]


def read_annotations(path: Path) -> list[tuple[int, str, str]]:
    """(sample, symbol, note) of an annotation file."""
    data = path.read_bytes()
    out, at, k = [], 0, 0
    while k + 1 < len(data):
        word = struct.unpack_from("<H", data, k)[0]
        code, value = word >> 10, word & 0x3FF
        k += 2
        if code == 0 and value == 0:
            break
        if code == SKIP:
            high, low = struct.unpack_from("<HH", data, k)
            step = high << 16 | low
            at += step - (1 << 32) if step & 0x80000000 else step
            k += 4
        elif code == AUX:
            note = data[k : k + value].rstrip(b"\0").decode("utf-8", "replace")
            k += value + value % 2
            if out:
                out[-1] = (out[-1][0], out[-1][1], note)
        elif code not in (NUM, SUB, CHN):
            at += value
            out.append((at, SYMBOLS.get(code, "?"), ""))
    return out


def write_record(folder: Path, name: str, rate: int, signals: dict[str, list[float]], marks: list[tuple[int, str, str]] = (), gain: float = 200.0) -> None:
    """A record of format 16 with annotations (sample, symbol, note), for exchange with other readers."""
    folder.mkdir(parents=True, exist_ok=True)
    values = np.stack([np.round(np.asarray(x, float) * gain).astype("<i2") for x in signals.values()], axis=1)
    (folder / f"{name}.dat").write_bytes(values.tobytes())
    lines = [f"{name} {len(signals)} {rate} {len(values)}", *(f"{name}.dat 16 {gain:g}/mV 16 0 0 0 0 {lead}" for lead in signals)]
    (folder / f"{name}.hea").write_text("\n".join(lines) + "\n")
    code, out, at = {v: k for k, v in SYMBOLS.items()}, bytearray(), 0
    for sample, symbol, note in sorted(marks, key=lambda m: m[0]):
        step = sample - at
        if step > 0x3FF:
            out += struct.pack("<HHH", SKIP << 10, step >> 16, step & 0xFFFF)
            step = 0
        out += struct.pack("<H", code[symbol] << 10 | step)
        at = sample
        if note:
            text = note.encode()
            out += struct.pack("<H", AUX << 10 | len(text)) + text + b"\0" * (len(text) % 2)
    (folder / f"{name}.atr").write_bytes(bytes(out) + b"\0\0")


class WfdbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.records = options.get("root", "."), [r for r in options.get("records", "").split(",") if r]
        self.start, self.end = int(options.get("sampfrom", 0)), int(options["sampto"]) if options.get("sampto") else None
        self.annotator, self.header_only = options.get("annotator", "atr"), options.get("headeronly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.records]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        base = Path(self.root) / partition.value
        header = read_header(base.with_suffix(".hea"))
        end = min(x for x in (self.end, header["n"]) if x is not None) if self.end or header["n"] else 0
        signals, beats, notes = [], None, None
        if not self.header_only:
            signals = [x.tolist() for x in read_signals(base.parent, header, self.start, end)]
            marks = base.with_suffix(f".{self.annotator}")
            if marks.exists():
                inside = [(s, sym, note) for s, sym, note in read_annotations(marks) if self.start <= s < end]
                beats = [(s - self.start, sym) for s, sym, _ in inside if sym not in ("+", "")]
                notes = [(s - self.start, note) for s, _, note in inside if note]
        yield (partition.value, header["fs"], header["n"], self.start, end, [s["name"] for s in header["signals"]], signals, beats, notes)


class WfdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WfdbReader:
        return WfdbReader(self.options)
