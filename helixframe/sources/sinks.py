"""FASTA, graph files, spectrum tables and plots, metadata, run log."""

from __future__ import annotations

import json
import logging
import math
import struct
import time
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import consecutive

LINE = 80
REPORTED_BINS = 500


def numbered(contigs: DataFrame, min_length: int) -> DataFrame:
    """Contigs of at least ``min_length`` bases with consecutive numbers from 0, longest first, then by sequence."""
    long = contigs.select("seq", F.length("seq").alias("len")).filter(F.col("len") >= min_length)
    return consecutive(long.orderBy(F.desc("len"), "seq")).select("number", "seq", "len")


def fasta_records(contigs: DataFrame, min_length: int = 0, width: int = LINE) -> DataFrame:
    """number and value, the text of each record: a header with the number and lines of ``width`` bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return numbered(contigs, min_length).select("number", F.concat(F.lit(">"), F.col("number"), F.lit("\n"), body).alias("value"))


def write_fasta(contigs: DataFrame, min_length: int, path: str, gzip: bool = False) -> int:
    """Write one FASTA file below ``path`` and return the number of records."""
    records = fasta_records(contigs, min_length)
    lines = records.repartitionByRange(1, "number").sortWithinPartitions("number").select("value")
    lines.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)
    return records.count()


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One of each edge and its mirror image."""
    forward = F.struct("src", "so", "dst", "do")
    back = F.struct(F.col("dst").alias("src"), F.when(F.col("do") == "+", "-").otherwise("+").alias("so"), F.col("src").alias("dst"), F.when(F.col("so") == "+", "-").otherwise("+").alias("do"))
    return edges.select(F.least(forward, back).alias("e")).distinct().select("e.*")


def gfa_lines(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """GFA 1: header, segments with length and k-mer count, links overlapping by k-1 bases. Columns part and value."""
    head = nodes.sparkSession.createDataFrame([(0, "H\tVN:Z:1.1")], "part int, value string")
    segments = nodes.select(F.lit(1).alias("part"), F.concat_ws("\t", F.lit("S"), "nid", "seq", F.concat(F.lit("LN:i:"), F.length("seq")), F.concat(F.lit("KC:i:"), F.round(F.col("cov") * F.col("n_kmers")).cast("long"))).alias("value"))
    links = canonical_edges(edges).select(F.lit(2).alias("part"), F.concat_ws("\t", F.lit("L"), "src", "so", "dst", "do", F.lit(f"{k - 1}M")).alias("value"))
    return head.union(segments).union(links)


def gfa2_lines(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """GFA 2: segments and edges with the overlapping ends as intervals."""
    head = nodes.sparkSession.createDataFrame([(0, "H\tVN:Z:2.0")], "part int, value string")
    size = nodes.select("nid", F.length("seq").alias("len"))
    segments = nodes.select(F.lit(1).alias("part"), F.concat_ws("\t", F.lit("S"), "nid", F.length("seq"), "seq").alias("value"))
    sized = canonical_edges(edges).join(size.toDF("src", "src_len"), "src").join(size.toDF("dst", "dst_len"), "dst")
    mark = lambda at, length: F.concat(at.cast("string"), F.when(at == length, "$").otherwise(""))

    def interval(orient: str, length: str, leaving: str):
        at_end = F.col(orient) == leaving
        first = F.when(at_end, F.col(length) - (k - 1)).otherwise(F.lit(0))
        return F.concat_ws("\t", mark(first, F.col(length)), mark(first + (k - 1), F.col(length)))

    links = sized.select(F.lit(2).alias("part"), F.concat_ws("\t", F.lit("E"), F.lit("*"), F.concat("src", "so"), F.concat("dst", "do"), interval("so", "src_len", "+"), interval("do", "dst_len", "-"), F.lit("*")).alias("value"))
    return head.union(segments).union(links)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph {"), (3, "}")], "part int, value string")
    boxes = nodes.select(F.lit(1).alias("part"), F.format_string('  %d [label="%d: %d bases, %d k-mers seen %d times"]', "nid", "nid", F.length("seq"), "n_kmers", F.round(F.col("cov") * F.col("n_kmers")).cast("long")).alias("value"))
    arrows = edges.select(F.lit(2).alias("part"), F.format_string('  %d -> %d [label="%s%s"]', "src", "dst", "so", "do").alias("value"))
    return ends.union(boxes).union(arrows)


def write_graph(nodes: DataFrame, edges: DataFrame, k: int, base: str) -> list[str]:
    """Write ``base`` with .dot, .gfa and .gfa2 appended; the prefix keeps its own dots."""
    made = []
    for extension, lines in (("dot", dot_lines(nodes, edges)), ("gfa", gfa_lines(nodes, edges, k)), ("gfa2", gfa2_lines(nodes, edges, k))):
        path = f"{base}.{extension}"
        lines.repartitionByRange(1, "part").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)
        made.append(path)
    return made


def step_name(prefix: str, k: int, final: bool) -> str:
    return f"{prefix}_contigs.fasta" if final else f"{prefix}_k{k}_contigs.fasta"


def spectrum_name(prefix: str, k: int, floor: int | None = None, log_scale: bool = False) -> str:
    return f"{prefix}_k{k}_kmerspectrum" + (f"_q{floor}" if floor is not None else "") + ("_log" if log_scale else "")


def spectrum_rows(spectrum: DataFrame) -> DataFrame:
    """Every bin up to the last occupied one, empty ones in between included."""
    last = spectrum.filter("distinct > 0").agg(F.max("count").alias("last"))
    bins = last.filter("last is not null").select(F.explode(F.sequence(F.lit(1), F.col("last"))).alias("count"))
    return bins.join(spectrum, "count", "left").select("count", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def write_spectrum_tsv(spectrum: np.ndarray, path: str) -> None:
    """At most 8000 lines, so the driver writes them."""
    used = np.flatnonzero(spectrum)
    rows = [f"{c}\t{int(spectrum[c - 1])}" for c in range(1, (int(used[-1]) + 1 if len(used) else 0) + 1)]
    Path(path).write_text("\n".join(["count\tdistinct", *rows]) + "\n")


def spectrum_svg(spectrum: np.ndarray, markers: dict[str, int | None], log_scale: bool = False, fitted: np.ndarray | None = None, size: tuple[int, int] = (900, 500)) -> str:
    """A bar plot of the spectrum; the linear one is cut at three times the peak's bar, so that errors do not flatten it."""
    width, height = size
    peak = markers.get("peak")
    used = np.flatnonzero(spectrum[:-1])
    last = min(int(used[-1]) + 1 if len(used) else 10, 4 * peak if peak else REPORTED_BINS, len(spectrum))
    bars = spectrum[:last].astype(float)
    top = max(bars.max(initial=1), 1)
    if peak and not log_scale:
        top = min(top, 3 * max(spectrum[peak - 1], 1))
    scale = (lambda v: math.log10(max(v, 1)) / math.log10(max(top, 10))) if log_scale else (lambda v: min(v / top, 1))
    left, bottom = 70, height - 50
    step, tall = (width - left - 20) / last, bottom - 20
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<rect width="{width}" height="{height}" fill="white"/>']
    out += [f'<rect x="{left + i * step:.2f}" y="{bottom - tall * scale(v):.2f}" width="{max(step - 0.3, 0.3):.2f}" height="{tall * scale(v):.2f}" fill="#4878a8"/>' for i, v in enumerate(bars) if v]
    if fitted is not None:
        points = " ".join(f"{left + (i + 0.5) * step:.2f},{bottom - tall * scale(v):.2f}" for i, v in enumerate(fitted[:last]))
        out.append(f'<polyline points="{points}" fill="none" stroke="#c44e52" stroke-width="1.5"/>')
    for name, count in markers.items():
        if count and count <= last:
            x = left + (count - 0.5) * step
            out.append(f'<line x1="{x:.2f}" x2="{x:.2f}" y1="20" y2="{bottom}" stroke="#333" stroke-dasharray="4 3"/><text x="{x + 3:.2f}" y="32">{name} {count}</text>')
    out.append(f'<line x1="{left}" x2="{width - 20}" y1="{bottom}" y2="{bottom}" stroke="black"/><line x1="{left}" x2="{left}" y1="20" y2="{bottom}" stroke="black"/>')
    out += [f'<text x="{left + f * (width - left - 20):.0f}" y="{bottom + 18}" text-anchor="middle">{round(1 + f * (last - 1))}</text>' for f in (0, 0.25, 0.5, 0.75, 1)]
    out.append(f'<text x="{width / 2}" y="{height - 12}" text-anchor="middle">count</text><text x="16" y="{height / 2}" transform="rotate(-90 16 {height / 2})" text-anchor="middle">distinct k-mers{" (log)" if log_scale else ""}</text></svg>')
    return "\n".join(out)


# Letters of three by five pixels, a row of three bits after the other.
GLYPHS = {
    "0": 0o75557, "1": 0o26227, "2": 0o71747, "3": 0o71717, "4": 0o55711, "5": 0o74717, "6": 0o74757, "7": 0o71111, "8": 0o75757, "9": 0o75717,
    "a": 0o07577, "b": 0o44757, "c": 0o07447, "d": 0o11757, "e": 0o07747, "f": 0o34644, "g": 0o75717, "h": 0o44755, "i": 0o20222, "j": 0o10117, "k": 0o45655, "l": 0o44447, "m": 0o05775,
    "n": 0o06555, "o": 0o07557, "p": 0o75744, "q": 0o75711, "r": 0o07444, "s": 0o34216, "t": 0o47443, "u": 0o05557, "v": 0o05552, "w": 0o05577, "x": 0o05255, "y": 0o55717, "z": 0o07247,
    "-": 0o00700, ".": 0o00002, "(": 0o24442, ")": 0o21112,
}


def _write(image: np.ndarray, row: int, column: int, text: str, scale: int = 2) -> None:
    """Text from its upper left corner on; unknown letters are blanks, and what lies outside is cut off."""
    for i, letter in enumerate(text.lower()):
        bits = GLYPHS.get(letter, 0)
        for p in range(15):
            if bits >> (14 - p) & 1:
                y, x = row + p // 3 * scale, column + (4 * i + p % 3) * scale
                image[max(y, 0) : max(y + scale, 0), max(x, 0) : max(x + scale, 0)] = 51


def spectrum_png(spectrum: np.ndarray, markers: dict[str, int | None], log_scale: bool = False, size: tuple[int, int] = (900, 500)) -> bytes:
    """The same bars, axes and markers as pixels."""
    width, height = size
    peak = markers.get("peak")
    used = np.flatnonzero(spectrum[:-1])
    last = min(int(used[-1]) + 1 if len(used) else 10, 4 * peak if peak else REPORTED_BINS, len(spectrum))
    bars = spectrum[:last].astype(float)
    top = max(bars.max(initial=1), 1)
    if peak and not log_scale:
        top = min(top, 3 * max(spectrum[peak - 1], 1))
    tall = np.log10(np.maximum(bars, 1)) / math.log10(max(top, 10)) if log_scale else np.minimum(bars / top, 1)
    left, bottom, plot = 70, height - 50, width - 90
    image = np.full((height, width, 3), 255, np.uint8)
    column = np.minimum(np.arange(plot) * last // plot, last - 1)
    high = np.round(tall[column] * (bottom - 20))
    rows = np.arange(height)[:, None]
    image[:, left : left + plot][(rows >= bottom - high[None, :]) & (rows < bottom)] = (72, 120, 168)
    image[bottom, left : left + plot] = image[20:bottom, left] = 0
    for name, count in markers.items():
        if count and count <= last:
            x = left + min(int((count - 0.5) * plot / last), plot - 1)
            image[20:bottom:6, x] = 51
            _write(image, 22, x + 4, f"{name} {count}")
    for f in (0, 0.25, 0.5, 0.75, 1):
        label = str(round(1 + f * (last - 1)))
        _write(image, bottom + 8, left + int(f * plot) - 4 * len(label), label)
        value = str(round(10 ** (f * math.log10(max(top, 10))) if log_scale else f * top))
        _write(image, bottom - int(f * (bottom - 20)) - 5, left - 8 * len(value) - 4, value)
    _write(image, height - 20, left + plot // 2 - 20, "count")
    _write(image, 4, 4, "distinct k-mers (log)" if log_scale else "distinct k-mers")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_spectrum_plots(spectrum: np.ndarray, markers: dict[str, int | None], base: str, fitted: np.ndarray | None = None) -> list[str]:
    """SVG and PNG, linear and logarithmic."""
    made = []
    for log_scale, suffix in ((False, ""), (True, "_log")):
        for kind, content in (("svg", spectrum_svg(spectrum, markers, log_scale, fitted).encode()), ("png", spectrum_png(spectrum, markers, log_scale))):
            Path(f"{base}{suffix}.{kind}").write_bytes(content)
            made.append(f"{base}{suffix}.{kind}")
    return made


def preprocessing_json(n_kmers: int, spectrum: np.ndarray, min_count: int, k: int, many_k: bool) -> str:
    return json.dumps({"nkmers": n_kmers, "histo": spectrum[:REPORTED_BINS].tolist(), "used_min_count": min_count, "k": k, "multik": many_k})


def assembly_json(contigs: DataFrame, min_length: int) -> str:
    return json.dumps({"ncontigs": contigs.filter(F.length("seq") >= min_length).count()})


def run_log(path: str) -> logging.Logger:
    """A logger to the console and to a file it appends to, with the seconds since now before each line."""
    began = time.monotonic()

    class Elapsed(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            return f"{time.monotonic() - began:9.2f} {super().format(record)}"

    logger = logging.getLogger("helixframe")
    logger.setLevel(logging.INFO)
    for handler in (logging.StreamHandler(), logging.FileHandler(path, mode="a")):
        handler.setFormatter(Elapsed("%(levelname)s %(message)s"))
        logger.addHandler(handler)
    return logger

