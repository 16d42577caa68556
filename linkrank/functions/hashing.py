"""Ids and fingerprints: two 32-bit multiplicative lanes over UTF-16 units, and a short context hash."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds and multipliers of the two lanes.
LANE_1, LANE_2 = (0x811C9DC5, 0x01000193), (0x9E3779B9, 0x85EBCA6B)
MASK = 0xFFFFFFFF


def _units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    return F.when(raw == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.char_length(raw) / 4).cast("int") - 1), lambda i: F.conv(F.substr(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long")))


def _lane(units: Column, seed: int, by: int) -> Column:
    """(h xor unit) * by in 32 bits; the product is split so that it stays below 63 bits."""

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(u)
        low, high = x.bitwiseAND(F.lit(65535)), F.shiftright(x, 16)
        return (low * by + (high * by).bitwiseAND(F.lit(65535)) * 65536).bitwiseAND(F.lit(MASK))

    return F.aggregate(units, F.lit(seed).cast("long"), step)


def hash_text(text: Column) -> Column:
    """16 hexadecimal digits."""
    units = _units(text)
    part = lambda lane: F.lpad(F.lower(F.hex(_lane(units, *lane))), 8, "0")
    return F.concat(part(LANE_1), part(LANE_2))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("document-"), hash_text(F.lower(path)))


def context_hash(text: Column) -> Column:
    """The first lane in base 36."""
    return F.lower(F.conv(_lane(_units(text), *LANE_1).cast("string"), 10, 36))


#: Parts of a request's key, in order.
REQUEST = ("file_path", "document_version", "anchor_start", "anchor_end", "anchor_text", "context_hash", "mode")


def request_key(**parts: Column) -> Column:
    """The parts of a request as a JSON array, in order."""
    of = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), "^\\{\"x\":(.*)\\}$", 1)
    return F.concat(F.lit("["), F.concat_ws(",", *[of(parts[name]) for name in REQUEST]), F.lit("]"))


def valid_request(**parts: Column) -> Column:
    """True for a request whose parts fit each other: a range of whole numbers that is as long as the anchor's text."""
    p = parts
    length = F.octet_length(F.encode(p["anchor_text"], "UTF-16BE")) / 2
    ok = (p["file_path"] != "") & (p["document_version"] >= 0) & (p["anchor_start"] >= 0) & (p["anchor_end"] > p["anchor_start"]) & (length == p["anchor_end"] - p["anchor_start"]) & (p["context_hash"] != "") & p["mode"].isin("automatic", "manual")
    return F.coalesce(ok, F.lit(False))


def hash_text_py(text: str) -> str:
    """The same as :func:`hash_text` for one string on the driver or in a Python function."""
    raw = text.encode("utf-16-be", "surrogatepass")
    out = []
    for seed, by in (LANE_1, LANE_2):
        h = seed
        for i in range(0, len(raw), 2):
            h = ((h ^ (raw[i] << 8 | raw[i + 1])) * by) & MASK
        out.append(f"{h:08x}")
    return "".join(out)


def chunk_id(document: str, heading_path: list[str], text: str, occurrence: int) -> str:
    return "chunk-" + hash_text_py(json.dumps([document, heading_path, text, occurrence], ensure_ascii=False, separators=(",", ":")))


def content_hash(path: str, title: str, aliases: list[str], headings: list, tags: list[str], outgoing: list[str], content: str) -> str:
    fields = {"path": path, "title": title, "aliases": aliases, "headings": headings, "tags": tags, "outgoingPaths": outgoing, "content": content}
    return hash_text_py(json.dumps(fields, ensure_ascii=False, separators=(",", ":")))


def scope_fingerprint(files: list[str], folders: list[str], tags: list[str], properties: list[str]) -> str:
    """Hash of the four exclusion lists, independent of order, case and slashes."""
    path = lambda x: x.replace("\\", "/").strip("/").lower()
    plain = lambda x: x.strip().removeprefix("#").lower()
    lists = {"files": map(path, files), "folders": map(path, folders), "tags": map(plain, tags), "properties": (x.strip().lower() for x in properties)}
    return hash_text_py(json.dumps({k: sorted({x for x in v if x}) for k, v in lists.items()}, ensure_ascii=False, separators=(",", ":")))
