"""BAM files: blocked gzip, read and written without other libraries. One file is one task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fastq import PER_FILE, ranked

#: Fixed values of the format.
OPS, BASES, EMPTY_BLOCK = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SCHEMA = "read_id string, flag int, chrom string, pos long, mapq int, cigar string, seq string, scores array<int>, tags map<string,string>"


def inflate(raw: bytes) -> bytes:
    """All members of a blocked gzip stream."""
    out = []
    while raw:
        d = zlib.decompressobj(wbits=31)
        out.append(d.decompress(raw))
        if not d.eof:
            raise ValueError("the last block is cut off")
        raw = d.unused_data
    return b"".join(out)


def deflate(data: bytes) -> bytes:
    """Blocks of up to 64 KB and the empty block that ends a file."""
    out = []
    for at in range(0, len(data), 60_000):
        part = data[at : at + 60_000]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + EMPTY_BLOCK


def _tags(raw: bytes) -> dict[str, str]:
    tags, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            form = f"<{n}{SIZES[sub]}"
            value, at = ",".join([sub, *map(str, struct.unpack_from(form, raw, at + 5))]), at + 5 + struct.calcsize(form)
        else:
            form = "<" + SIZES[kind]
            value, at = str(struct.unpack_from(form, raw, at)[0]), at + struct.calcsize(form)
        tags[name] = value
    return tags


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, place of the first record)."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    count, at = struct.unpack_from("<i", data, at)[0], at + 4
    contigs = []
    for _ in range(count):
        size = struct.unpack_from("<i", data, at)[0]
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return text, contigs, at


def records(data: bytes) -> Iterator[dict]:
    _, contigs, at = header(data)
    while at < len(data):
        size, tid, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiiBBHHHi", data, at)
        p = at + 36
        name, p = data[p : p + n_name - 1].decode(), p + n_name
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, p))
        p += 4 * n_cigar
        packed, p = data[p : p + (n_seq + 1) // 2], p + (n_seq + 1) // 2
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
        scores, p = list(data[p : p + n_seq]), p + n_seq
        yield {"read_id": name, "flag": flag, "chrom": contigs[tid][0] if tid >= 0 else None, "pos": pos, "mapq": mapq, "cigar": cigar, "seq": seq, "scores": scores, "tags": _tags(data[p : at + 4 + size])}
        at += 4 + size


def encode(text: str, contigs: list[tuple[str, int]], rows: list[dict]) -> bytes:
    """A whole file; tags are written as text (Z), qs and QS as numbers."""
    place = {c: i for i, (c, _) in enumerate(contigs)}
    out = [b"BAM\1", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(contigs))]
    for name, size in contigs:
        out += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", size)]
    code = {c: i for i, c in enumerate(BASES)}
    import re

    for r in rows:
        cigar = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r.get("cigar") or "")]
        seq, name = r["seq"].upper(), r["read_id"].encode() + b"\0"
        nibbles = [code.get(b, 15) for b in seq] + [0] * (len(seq) % 2)
        body = [struct.pack("<iiBBHHHiiii", place.get(r.get("chrom"), -1), r.get("pos", -1), len(name), r.get("mapq", 255) & 255, 4680, len(cigar), r.get("flag", 4), len(seq), -1, -1, 0), name]
        body += [struct.pack("<I", n << 4 | o) for n, o in cigar]
        body += [bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True)), bytes(r.get("scores") or [255] * len(seq))]
        for tag, value in (r.get("tags") or {}).items():
            body.append(tag.encode() + (b"f" + struct.pack("<f", float(value)) if tag in ("qs", "QS") else b"Z" + str(value).encode() + b"\0"))
        whole = b"".join(body)
        out += [struct.pack("<i", len(whole)), whole]
    return deflate(b"".join(out))


def scan_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """alignments: file, ord (unique, in order of file name and place), read_id, flag, chrom (null if unmapped), pos from 0, mapq, cigar, seq, scores, tags."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"(?i)\.bam$"))
    files = ranked(files.select("path", "content"))

    def read(batches):
        for batch in batches:
            for name, content, rank in zip(batch["path"], batch["content"], batch["rank"], strict=True):
                rows = []
                for k, r in enumerate(records(inflate(content)), rank * PER_FILE):
                    rows.append({"file": name, "ord": k, **r})
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(read, f"file string, ord long, {SCHEMA}")


def scan_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contigs (chrom, len) of the headers."""
    files = spark.read.format("binaryFile").load(path)

    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(header(inflate(content))[1], columns=["chrom", "len"])

    return files.select("content").mapInPandas(read, "chrom string, len long").distinct()


#: Tags that an aligner writes, which an unaligned copy leaves out.
ALIGNER_TAGS = ["NM", "MD", "AS", "SA", "XA", "XS", "cs", "cm", "s1", "s2", "de", "rl", "tp", "ms", "nn", "dv", "cg", "MQ", "MC", "NH", "HI", "IH", "YS", "YT", "XN", "XM", "XG"]


def unaligned_copy(alignments: DataFrame) -> DataFrame:
    """Primary records as unaligned ones in reading direction: no place, no CIGAR, no aligner's tags, no one-letter ts."""
    from ..functions.sequence import reverse_complement_iupac

    reverse = F.col("flag").bitwiseAND(16) != 0
    tags = F.map_filter("tags", lambda k, v: ~k.isin(ALIGNER_TAGS) & ~((k == "ts") & v.isin("+", "-")))
    return alignments.where(F.col("flag").bitwiseAND(0x900) == 0).select("read_id", F.lit(4).alias("flag"), F.when(reverse, reverse_complement_iupac(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(reverse, F.reverse("scores")).otherwise(F.col("scores")).alias("scores"), tags.alias("tags"))
