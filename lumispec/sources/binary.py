"""The four-file binary layout: header.bin, mass_index.bin, genome_peaks.bin, meta.bin, all little-endian.

It is one flat index with offsets into one file each, so it is written and read by the driver; at scale the Parquet library is the format.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schemas import BIN_WIDTH, SCHEMA_VERSION

#: Magic bytes; the header's fields (magic, version, bin width, genomes, peaks, offset and length of three sections, four CRCs,
#: reserved zeros); files.
MAGIC = b"GPMDB\0\1\0"
HEADER = struct.Struct("<8sIIQQQQQQQQIIII160s")
FILES = ("header.bin", "mass_index.bin", "genome_peaks.bin", "meta.bin")
CRC_AT = 80


def _strings(values: list[str]) -> tuple[list[int], list[str]]:
    """Dictionary ids of values, by first occurrence, and the dictionary; 0 is empty."""
    ids = {"": 0}
    return [ids.setdefault(v, len(ids)) for v in values], list(ids)


def _blob(entries: list[str]) -> tuple[bytes, bytes]:
    raw = [e.encode() for e in entries]
    return np.cumsum([0, *map(len, raw)]).astype("<u8").tobytes(), b"".join(raw)


def write(peaks: list[list[int]], genomes: list[tuple[str, int, str, int]], path: str | Path, bin_width: int = BIN_WIDTH) -> dict:
    """peaks: encoded m/z of each genome in order; genomes: display name, taxonomy id, taxonomy, gene count of each. Gives the counts."""
    if bin_width <= 0:
        raise ValueError("bin width must be positive")
    out = Path(path)
    out.mkdir(parents=True, exist_ok=True)
    sizes = np.array([len(p) for p in peaks], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, np.int64) for p in peaks)])
    bins = flat // bin_width
    bin_count = int(bins.max(initial=0)) + 1
    genome = np.repeat(np.arange(len(peaks)), sizes)
    local = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(bins, kind="stable")  # flat order is genome, then local index
    offsets = np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=bin_count))])
    index = struct.pack("<I", bin_count) + offsets.astype("<u8").tobytes() + np.stack([genome[order], local[order]], 1).astype("<u4").tobytes()
    name_ids, names = _strings([g[0] for g in genomes])
    text_ids, texts = _strings([g[2] for g in genomes])
    (name_at, name_blob), (text_at, text_blob) = _blob(names), _blob(texts)
    meta = b"".join([
        np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(), np.array([g[3] for g in genomes], "<u4").tobytes(), np.array([g[1] for g in genomes], "<u4").tobytes(),
        struct.pack("<II", len(names), len(texts)), name_at, text_at, np.array(name_ids, "<u4").tobytes(), np.array(text_ids, "<u4").tobytes(),
        struct.pack("<QQ", len(name_blob), len(text_blob)), name_blob, text_blob,
    ])
    stored = flat.astype("<u4").tobytes()
    at = HEADER.size
    sections = []
    for part in (index, stored, meta):
        sections += [at, len(part)]
        at += len(part)
    crcs = [zlib.crc32(x) for x in (index, stored, meta)]
    head = [MAGIC, SCHEMA_VERSION, bin_width, len(peaks), len(flat), *sections]
    crc = zlib.crc32(HEADER.pack(*head, 0, *crcs, b""))
    for name, data in zip(FILES, (HEADER.pack(*head, crc, *crcs, b""), index, stored, meta), strict=True):
        (out / name).write_bytes(data)
    return {"genome_count": len(peaks), "total_peak_count": len(flat), "bin_count": bin_count}


def header(raw: bytes) -> dict:
    if len(raw) < HEADER.size:
        raise ValueError("header.bin is too small")
    f = HEADER.unpack_from(raw)
    if f[0] != MAGIC:
        raise ValueError("header magic mismatch")
    if f[1] != SCHEMA_VERSION:
        raise ValueError(f"schema version mismatch: {f[1]}")
    names = ["bin_width", "genome_count", "total_peak_count", "index_at", "index_len", "peaks_at", "peaks_len", "meta_at", "meta_len", "crc_header", "crc_index", "crc_peaks", "crc_meta"]
    return dict(zip(names, f[2:15], strict=True)) | {"reserved": f[15]}


def read(path: str | Path) -> dict:
    """The sections as arrays: header, bin_offsets, postings, peaks, genome_offsets, gene_counts, taxonomy_ids, names, taxonomy."""
    folder = Path(path)
    raw = [(folder / f).read_bytes() for f in FILES]
    h = header(raw[0])
    g = h["genome_count"]
    bin_count = struct.unpack_from("<I", raw[1])[0]
    if len(raw[1]) < 4 + 8 * (bin_count + 1):
        raise ValueError("mass_index.bin is too small")
    offsets = np.frombuffer(raw[1], "<u8", bin_count + 1, 4).astype(np.int64)
    rest = raw[1][4 + 8 * (bin_count + 1) :]
    if len(rest) != 8 * offsets[-1]:
        raise ValueError("mass_index layout mismatch")
    if len(raw[2]) < 4 * h["total_peak_count"]:
        raise ValueError("genome_peaks.bin is too small")
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw[3], kind, n, at)
        at += x.nbytes
        return x.astype(np.int64)

    genome_offsets, genes, taxa = take("<u8", g + 1), take("<u4", g), take("<u4", g)
    n, t = take("<u4", 2).tolist()
    name_at, text_at, name_ids, text_ids = take("<u8", n + 1), take("<u8", t + 1), take("<u4", g), take("<u4", g)
    lengths = take("<u8", 2).tolist()
    names, texts = raw[3][at : at + lengths[0]], raw[3][at + lengths[0] : at + sum(lengths)]
    entry = lambda blob, ends, i: blob[ends[i] : ends[i + 1]].decode()
    return {
        "header": h, "bin_offsets": offsets, "postings": np.frombuffer(rest, "<u4").reshape(-1, 2).astype(np.int64), "peaks": np.frombuffer(raw[2], "<u4", h["total_peak_count"]).astype(np.int64),
        "genome_offsets": genome_offsets, "gene_counts": genes, "taxonomy_ids": taxa, "names": [entry(names, name_at, i) for i in name_ids], "taxonomy": [entry(texts, text_at, i) for i in text_ids],
    }


def validate(path: str | Path) -> tuple[bool, list[str]]:
    """Whether a folder holds a sound library, and the rules that it breaks. Files that are missing, or a header that can't be one, end the search;
    so does a faulty header, as what it points to would make no sense."""
    folder = Path(path)
    broken = [f"file:{f}" for f in FILES if not (folder / f).exists()]
    if broken:
        return False, broken
    raw = [(folder / f).read_bytes() for f in FILES]
    if len(raw[0]) != HEADER.size:
        return False, ["header_size"]
    f = HEADER.unpack(raw[0])
    sections = range(3)
    starts = np.cumsum([HEADER.size, *map(len, raw[1:])])
    rules = {
        "magic": f[0] == MAGIC, "schema_version": f[1] == SCHEMA_VERSION, "reserved": not any(f[15]), "bin_width": f[2] > 0, "metadata": len(raw[3]) > 0,
        "section_offsets": all(f[5 + 2 * k] == starts[k] for k in sections), "section_lengths": all(f[6 + 2 * k] == len(raw[1 + k]) for k in sections),
        **{f"checksum:{name}": f[12 + k] == zlib.crc32(raw[1 + k]) for k, name in enumerate(FILES[1:])},
        "peak_bytes": f[8] == 4 * f[4], "checksum:header.bin": f[11] == zlib.crc32(raw[0][:CRC_AT] + b"\0\0\0\0" + raw[0][CRC_AT + 4 :]),
    }
    broken = [name for name, holds in rules.items() if not holds]
    if broken:
        return False, broken
    try:
        x = read(folder)
    except (ValueError, struct.error, IndexError):
        return False, ["layout"]
    bins, genomes, (genome, local) = x["bin_offsets"], x["genome_offsets"], x["postings"].reshape(-1, 2).T
    whole = lambda offsets: offsets[0] == 0 and offsets[-1] == f[4] and not (np.diff(offsets) < 0).any()
    rules = {"bin_count": len(bins) > 1, "bin_offsets": whole(bins), "genome_offsets": whole(genomes), "posting_genome": not (genome >= f[3]).any()}
    if all(rules.values()):
        rules["posting_index"] = not (local >= np.diff(genomes)[genome]).any()
    if all(rules.values()):
        at = genomes[genome] + local
        rules["posting_bin"] = (x["peaks"][at] // f[2] == np.repeat(np.arange(len(bins) - 1), np.diff(bins))).all()
        rules["one_posting_a_peak"] = len(np.unique(at)) == f[4]
    broken = [name for name, holds in rules.items() if not holds]
    return not broken, broken


def to_frames(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """A binary library as peaks, postings and genomes."""
    x = read(path)
    offsets = x["genome_offsets"]
    sizes = np.diff(offsets)
    genome = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(genome)) - np.repeat(offsets[:-1], sizes)
    bins = np.repeat(np.arange(len(x["bin_offsets"]) - 1), np.diff(x["bin_offsets"]))
    import pandas as pd

    frame = lambda schema, **c: spark.createDataFrame(pd.DataFrame(c), schema)
    return {
        "peaks": frame("genome_id long, local_peak_idx long, milli_mz long", genome_id=genome, local_peak_idx=local, milli_mz=x["peaks"]),
        "postings": frame("bin_id long, genome_id long, local_peak_idx long", bin_id=bins, genome_id=x["postings"][:, 0], local_peak_idx=x["postings"][:, 1]),
        "genomes": frame("genome_id long, display_name string, taxonomy string, taxonomy_id long, gene_count long, total_peaks long", genome_id=np.arange(len(sizes)), display_name=x["names"], taxonomy=x["taxonomy"], taxonomy_id=x["taxonomy_ids"], gene_count=x["gene_counts"], total_peaks=sizes),
    }


def from_library(library, path: str | Path) -> dict:
    """Writes a Parquet library in the binary layout; its rows pass through the driver, genome by genome."""
    peaks: dict[int, list[int]] = {}
    for r in library.peaks.orderBy("genome_id", "local_peak_idx").toLocalIterator():
        peaks.setdefault(r.genome_id, []).append(r.milli_mz)
    rows = library.genomes.orderBy("genome_id").collect()
    return write([peaks.get(r.genome_id, []) for r in rows], [(r.display_name, r.taxonomy_id, r.taxonomy, r.gene_count) for r in rows], path, library.manifest["bin_width"])
