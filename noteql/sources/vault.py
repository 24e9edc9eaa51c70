"""Markdown collections and metric logs: which files there are, note loading, note files."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field

import pandas as pd
from noteql.functions import extract
from noteql.sources import conventions, files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INVENTORY = "kind string, relative_path string, file_modified_at timestamp, created_at timestamp, raw string"


@dataclass
class Settings:
    """What is read, and where: of the program's own settings, the editor's and the defaults, in that order."""

    attachments: str | None = None
    ignored: list[str] = field(default_factory=list)
    internal: str = ".noteql"
    metrics_root: str = "metrics"
    metrics_suffix: str | tuple[str, ...] = ".ndjson"
    daily_format: str | None = None
    metrics: conventions.Conventions | None = None


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return data if isinstance(data, dict) else {}
    except (OSError, ValueError):
        return {}


def load_settings(root: str, editor_dir: str = ".obsidian") -> Settings:
    """Settings from ``<editor_dir>/{app,daily-notes}.json`` and ``noteql.toml``; those of metric logs are the plugin's,
    or else the workspace's (``metrics_root``, ``metrics_suffix``, or a table ``metrics``), or else defaults."""
    app, daily = (_json(os.path.join(root, editor_dir, f"{n}.json")) for n in ("app", "daily-notes"))
    try:
        with open(os.path.join(root, "noteql.toml"), "rb") as f:
            own = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        own = {}
    default = Settings()
    workspace = {k: own[n] for k, n in (("root", "metrics_root"), ("extensions", "metrics_suffix")) if n in own} | (own.get("metrics") if isinstance(own.get("metrics"), dict) else {})
    logs = conventions.load(os.path.join(root, editor_dir), workspace, default.metrics_root, default.metrics_suffix, f"All{default.metrics_suffix}")
    return Settings(
        attachments=app.get("attachmentFolderPath") or own.get("attachments"),
        ignored=[x.strip("/") for x in [*app.get("userIgnoreFilters", []), *own.get("ignored", [])]],
        internal=own.get("internal", default.internal),
        metrics_root=logs.root,
        metrics_suffix=logs.extensions,
        daily_format=daily.get("format"),
        metrics=logs,
    )


def skipped_folder(relative: str, settings: Settings) -> bool:
    """Whether a folder's notes are left out: hidden ones, attachments, the program's own, ignored ones."""
    name = os.path.basename(relative)
    plain = relative.replace(os.sep, "/")
    if name.startswith(".") or name.lower() == "attachments" or name == settings.internal:
        return True
    return any(plain == x or plain.startswith(x + "/") for x in [*settings.ignored, *([settings.attachments.strip("/")] if settings.attachments else [])])


def scopes(paths: list[str]) -> list[str]:
    """The fewest subtrees that hold all paths."""
    out: list[str] = []
    for p in sorted({x.strip("/") for x in paths}):
        if "" in out or any(p == s or p.startswith(s + "/") for s in out):
            continue
        out = [""] if p == "" else [*out, p]
    return out


def rules(settings: Settings, kind: str = "notes") -> files.Rules:
    """Notes lie outside the folders that are left out; metric logs anywhere below their own folder."""
    return files.Rules(settings.metrics_suffix) if kind == "metrics" else files.Rules(".md", lambda folder: skipped_folder(folder, settings))


def list_vault(spark: SparkSession, root: str, kind: str = "notes", settings: Settings | None = None, subtrees: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """(relative_path, size, file_modified_at, created_at) of notes or metric logs, in subtrees alone if there are any;
    with ``distinct`` of several notes with one id the first by path, settled on the names."""
    settings = settings or load_settings(root)
    top = settings.metrics_root if kind == "metrics" else ""
    below = scopes(subtrees) if subtrees is not None else None
    if top:
        below = [top] if below is None else scopes([s if s == top or s.startswith(top + "/") else top for s in below if s == "" or s == top or s.startswith(top + "/") or top.startswith(s + "/")])
    found = files.listing(spark, root, rules(settings, kind), below)
    if distinct:
        found = found.withColumn("note_id", note_id(F.col("relative_path"))).groupBy("note_id").agg(F.min(F.struct(*found.columns)).alias("f")).select("f.*")
    return found


def read_vault(spark: SparkSession, root: str, kind: str = "notes", settings: Settings | None = None, subtrees: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """Files as INVENTORY has them."""
    return files.whole(list_vault(spark, root, kind, settings, subtrees, distinct), root, kind)


def note_id(path):
    return F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]*$", ""))


def inventory(found: DataFrame, distinct: bool = False) -> DataFrame:
    """Files with note_id; of several with one id the first by path. Paths alone are ranked, and the texts of notes whose
    id is there twice are all that is left out. ``distinct`` says that the listing has done so."""
    named = found.withColumn("note_id", note_id(F.col("relative_path")))
    if distinct:
        return named
    first = named.groupBy("note_id").agg(F.min("relative_path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("note_id", "first")
    later = named.select("note_id", "relative_path").join(first, "note_id").where("relative_path <> first").select("relative_path")
    return named.join(later, "relative_path", "left_anti")


def parse_yaml(text: str) -> dict | None:
    """A frontmatter block as JSON values; None if it is no mapping. Only null, true, false, integers and floats are
    other than text; dates stay as they are written."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
        ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$|^[-+]?[0-9]+[eE][-+]?[0-9]+$", "-+.0123456789"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^$"), [""])
    try:
        data = yaml.load(text, Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError:
        return None
    return {} if data is None else {str(k): v for k, v in data.items()} if isinstance(data, dict) else None


def _scalar(text: str):
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t in ("", "~", "null"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if re.fullmatch(r"[-+]?(0|[1-9]\d*)", t):
        return int(t)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", t):
        return float(t)
    if t.startswith("[") and t.endswith("]"):
        inside = t[1:-1].strip()
        return [_scalar(x) for x in re.findall(r'(?:"[^"]*"|\'[^\']*\'|[^,])+', inside)] if inside else []
    return t


def _plain_yaml(text: str) -> dict | None:
    """Mappings, lists and scalars by indentation, where no YAML library is at hand."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, indent: int):
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out: list = []
            while at < len(rows) and rows[at][0] == indent and rows[at][1].startswith("-"):
                out.append(_scalar(rows[at][1][1:]))
                at += 1
            return out, at
        made: dict = {}
        while at < len(rows) and rows[at][0] == indent:
            m = re.match(r"([^:#][^:]*):(?:\s+(.*))?$", rows[at][1])
            if not m:
                raise ValueError(rows[at][1])
            key, rest = m[1].strip().strip("\"'"), m[2]
            at += 1
            if rest is None and at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-")):
                made[key], at = block(at, rows[at][0])
            else:
                made[key] = _scalar(rest or "")
        if at < len(rows) and rows[at][0] > indent:
            raise ValueError(rows[at][1])
        return made, at

    if not rows:
        return {}
    try:
        data, at = block(0, rows[0][0])
    except (ValueError, IndexError):
        return None
    return data if isinstance(data, dict) and at == len(rows) else None


@F.pandas_udf(StringType())
def yaml_json(block: pd.Series) -> pd.Series:
    """JSON of YAML blocks; null where a block is no YAML mapping."""

    def one(text):
        data = parse_yaml(text)
        return None if data is None else json.dumps(data, ensure_ascii=False, default=str)

    return block.map(one, na_action="ignore")


def load_notes(found: DataFrame) -> DataFrame:
    """note_id, title, metadata_json, content, relative_path, file_modified_at, created_at, tags, aliases from an
    inventory. A block that is no YAML stays in the body, and the note has no metadata."""
    n = found.withColumn("block", extract.frontmatter(F.col("raw"))).withColumn("parsed", yaml_json("block"))
    n = n.withColumn("metadata_json", F.coalesce("parsed", F.lit("{}"))).withColumn("content", F.when(F.col("parsed").isNotNull(), extract.body(F.col("raw"))).otherwise(F.col("raw")))
    v = F.try_parse_json("metadata_json")
    texts = lambda x, path: F.coalesce(F.try_variant_get(x, path, "array<string>"), F.array(F.try_variant_get(x, path, "string")))
    # A value, an array, or an array with arrays in it.
    listed = lambda name: F.array_compact(F.coalesce(F.flatten(F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: texts(x, "$"))), texts(v, f"$.{name}")))
    return n.select(
        "note_id",
        extract.title(F.try_variant_get(v, "$.title", "string"), F.col("content")).alias("title"),
        "metadata_json",
        "content",
        "raw",
        "relative_path",
        "file_modified_at",
        "created_at",
        extract.tag_union(F.col("content"), listed("tags")).alias("tags"),
        extract.aliases(listed("aliases")).alias("aliases"),
    )


def metadata_rows(notes: DataFrame) -> DataFrame:
    """(note_id, key, value_json): one row a top-level field."""
    fields = F.from_json("metadata_json", "map<string,string>")
    return notes.select("note_id", F.explode(fields).alias("key", "text")).select("note_id", "key", F.coalesce("text", F.lit("null")).alias("value_json"))


def metadata_dates(notes: DataFrame) -> DataFrame:
    """(note_id, key, value): every metadata text, or element of an array, that is a date."""
    rows = metadata_rows(notes)
    texts = F.coalesce(F.from_json("value_json", "array<string>"), F.array("value_json"))
    each = rows.select("note_id", "key", F.explode(texts).alias("text"))
    return each.select("note_id", "key", extract.instant(F.col("text")).alias("value")).where("value is not null")


def compose(metadata: dict, body: str) -> str:
    if not metadata:
        return body
    lines = [f"{k}: {json.dumps(v, ensure_ascii=False) if not isinstance(v, str) or not re.fullmatch(r'[A-Za-z0-9 _./-]+', v) else v}" for k, v in metadata.items()]
    return "---\n" + "\n".join(lines) + "\n---\n" + body


def _inside(root: str, relative: str) -> str:
    full = os.path.realpath(os.path.join(root, relative))
    if not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{relative!r} is outside")
    return full


def create_note(root: str, relative: str, metadata: dict, body: str) -> None:
    full = _inside(root, relative)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "x", encoding="utf-8") as f:
        f.write(compose(metadata, body))


def replace_note(root: str, relative: str, metadata: dict, body: str) -> None:
    full = _inside(root, relative)
    with open(full + ".new", "w", encoding="utf-8") as f:
        f.write(compose(metadata, body))
    os.replace(full + ".new", full)


def delete_note(root: str, relative: str) -> None:
    """Removes a note, and the folders above that are empty then."""
    full = _inside(root, relative)
    os.remove(full)
    folder = os.path.dirname(full)
    while folder != os.path.realpath(root) and not os.listdir(folder):
        os.rmdir(folder)
        folder = os.path.dirname(folder)


def create_file(root: str, relative: str) -> None:
    """An empty file; one that is there is an error."""
    full = _inside(root, relative)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "x", encoding="utf-8"):
        pass


def rename_file(root: str, old: str, new: str) -> None:
    """Moves a file to a name that is free: the new name is made by a link, which fails if it is there."""
    a, b = _inside(root, old), _inside(root, new)
    if a == b:
        raise ValueError("the names must differ")
    os.makedirs(os.path.dirname(b), exist_ok=True)
    os.link(a, b)
    os.remove(a)


def delete_file(root: str, relative: str) -> None:
    os.remove(_inside(root, relative))
