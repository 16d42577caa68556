"""Notes from files: Markdown texts under a folder of any Hadoop file system, with the metadata of their front matter.

Files are chosen by extension and by the exclusion rules on paths before a byte of them is read; rules on tags and
properties follow, since they need the text. A note that can't be decoded as UTF-8 is told apart, so that an index can keep what it had of it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.operators import incremental
from linkrank.sources import snapshot

_front = re.compile(r"\A---[\t ]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[\t ]*(?:\r?\n|\Z)", re.DOTALL)
_member = re.compile(r"([^\s:#][^:]*?)\s*:(?:\s+(.*))?\Z")
_item = re.compile(r"\s*-\s+(.*)\Z")
_heading = re.compile(r"(?m)^[\t ]{0,3}#{1,6}[\t ]+(.+?)[\t ]*#*[\t ]*$")
_tag = re.compile(r"(?<!\S)#([^\W\d][\w/-]*|[\w/-]*[^\W\d][\w/-]*)")
_fenced = re.compile(r"(?ms)^[\t ]{0,3}(`{3,}|~{3,}).*?(?:^[\t ]{0,3}\1[`~]*[\t ]*$|\Z)")


def _value(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def properties(front: str) -> dict[str, list[str]]:
    """Names and values of front matter: plain values, lists in brackets or below each other. Deeper structures are left out."""
    out: dict[str, list[str]] = {}
    name = None
    for line in front.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if item := _item.match(line):
            if name is not None:
                out[name].append(_value(item[1]))
        elif member := _member.match(line):
            name, value = member[1].strip().lower(), (member[2] or "").strip()
            listed = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else [value]
            out[name] = [v for v in map(_value, listed) if v]
    return out


def parse(path: str, text: str) -> dict:
    """Title, aliases, headings, tags, properties and body of a note."""
    front = _front.match(text)
    fields = properties(front[1]) if front else {}
    body = text[front.end() :] if front else text
    base = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    plain = _fenced.sub("", body)
    own = [t.lstrip("#") for key in ("tags", "tag") for value in fields.get(key, []) for t in re.split(r"[\s,]+", value) if t.lstrip("#")]
    title = next((t.strip() for t in fields.get("title", []) if t.strip()), base)
    aliases = fields.get("aliases") or fields.get("alias") or []
    return {
        "path": path, "title": title, "basename": base, "aliases": list(dict.fromkeys(a.strip() for a in aliases if a.strip())),
        "headings": [h.strip() for h in _heading.findall(plain) if h.strip()], "tags": sorted({*own, *_tag.findall(plain)}),
        "properties": [{"key": k, "value": v} for k, v in fields.items()], "body": body,
    }


_strings = pa.list_(pa.string())
_schema = pa.schema([("path", pa.string()), ("title", pa.string()), ("basename", pa.string()), ("aliases", _strings), ("headings", _strings), ("tags", _strings), ("properties", pa.list_(pa.struct([("key", pa.string()), ("value", _strings)]))), ("body", pa.string()), ("modified_at", pa.int64()), ("readable", pa.bool_())])
SCHEMA = "path string, title string, basename string, aliases array<string>, headings array<string>, tags array<string>, properties array<struct<key:string,value:array<string>>>, body string, modified_at long, readable boolean"


def read_notes(spark: SparkSession, root: str, files: list[str] = (), folders: list[str] = (), tags: list[str] = (), rules: list[str] = ()) -> DataFrame:
    """Notes below ``root`` that no rule excludes: ``SCHEMA``, paths relative to ``root``, modified_at in milliseconds.

    Unreadable notes are rows with readable false and nothing but path and time.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    fs, given, _ = snapshot.hadoop(spark, root)
    base = fs.makeQualified(given).toUri().getPath().rstrip("/")
    local = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    named = whole.select(F.substr(local, F.lit(len(base) + 2)).alias("path"), F.unix_millis("modificationTime").alias("modified_at"), "content")
    chosen = named.where(~incremental.excluded(named, list(files), list(folders)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for path, modified, content in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns)):
                    try:
                        rows.append(parse(path, content.decode()) | {"modified_at": modified, "readable": True})
                    except UnicodeDecodeError:
                        rows.append({"path": path, "modified_at": modified, "readable": False})
                yield pa.RecordBatch.from_pylist(rows, schema=_schema)

    notes = chosen.mapInArrow(run, SCHEMA)
    if tags:
        notes = notes.where(F.col("tags").isNull() | ~incremental.excluded(notes, tags=list(tags)))
    if rules:
        held = F.map_from_entries(F.coalesce("properties", F.array().cast("array<struct<key:string,value:array<string>>>")))
        notes = notes.where(~incremental.property_excluded(held, list(rules)))
    return notes
