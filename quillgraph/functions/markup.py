"""Parsing that needs a scanner: frontmatter, links with spans, code, headings, JSON replies, edits.

Plain functions over one text each; ``parsed_notes`` applies them in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.runtime import spread

try:
    import yaml
except ImportError:
    yaml = None

_FRONT = re.compile(r"\A---\r?\n(.*?)(?<=\n)---(?:\r?\n|\Z)", re.S)
_WIKI = re.compile(r"\[\[([^\]\n]*)\]\]")
_MDLINK = re.compile(r"(!?)\[([^\]\n]*)\]\(\s*<?([^()\s<>]+)>?(?:\s+[\"'(][^)]*)?\s*\)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+([^\r\n]*?))??(?:[ \t]+#+)?[ \t]*\r?$", re.M)
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-{2,})[ \t]*$", re.M)
_MAYBE_CODE = re.compile(r"`|~~~|^(?: {4}|\t)", re.M)
_TAG = re.compile(r"(?:\A|[\s(])#([^\W\d][\w/-]*)")


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """(YAML, body). An empty block is body text."""
    m = _FRONT.match(text)
    return (m.group(1), text[m.end() :]) if m and m.group(1) else (None, text)


if yaml:

    class _Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Scalars of the JSON schema only: dates and 'yes' stay strings."""

    _Core.yaml_implicit_resolvers = {}
    for _tag, _rx, _first in (
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("tag:yaml.org,2002:int", r"^[-+]?[0-9]+$", list("-+0123456789")),
        ("tag:yaml.org,2002:float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+.0123456789")),
    ):
        _Core.add_implicit_resolver(_tag, re.compile(_rx), _first)


def yaml_value(block: str | None):
    """The block's value; None when it is missing or cannot be read. The last of equal keys wins."""
    if block is None:
        return None
    try:
        if yaml:
            return yaml.load(block.replace("\r", ""), Loader=_Core)
    except Exception:  # noqa: BLE001 - unreadable frontmatter is a defined result
        return None
    return {k.strip(): v.strip() for k, s, v in (line.partition(":") for line in block.splitlines()) if s}


def as_text(v) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (str, int, float)) else None


def as_list(v) -> list[str]:
    return [t for t in map(as_text, v if isinstance(v, list) else [v]) if t is not None]


_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?: +|$)")
_SPAN = re.compile(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", re.S)


def _blocks(body: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """(code blocks, paragraphs as lists of line ranges) of a body.

    A line indented by four blanks beyond the list item it stands in is code unless it continues a paragraph.
    """
    code, paragraphs, at, fence, start = [], [], 0, None, 0
    inner, open_ = [], False  # content columns of the list items around; whether a paragraph is open
    for line in body.splitlines(keepends=True):
        end = at + len(line)
        flat = line.expandtabs(4)
        s = flat.lstrip(" ")
        indent, text = len(flat) - len(s), s.strip()
        if fence:
            if indent - (inner[-1] if inner else 0) < 4 and text.startswith(fence) and not text.strip(fence[0]):
                code.append((start, end))
                fence = None
        elif not text:
            open_ = False
        else:
            while inner and indent < inner[-1] and not open_:
                inner.pop()
            base = inner[-1] if inner and indent >= inner[-1] else 0
            if indent - base >= 4 and not open_:
                code.append((at, end))
            elif m := re.match(r"(`{3,})[^`\n]*$|(~{3,})", s.rstrip("\r\n")):
                fence, start, open_ = m.group(1) or m.group(2), at, False
            else:
                item = _ITEM.match(flat[base:]) if indent - base < 4 else None
                if item and not re.match(r"(?:[-*_][ \t]*){3,}$", text):
                    while inner and inner[-1] > indent:
                        inner.pop()
                    rest = flat[base:][item.end() :].strip()
                    inner.append(base + (item.end() if rest and item.end() - len(item.group().rstrip()) <= 4 else len(item.group().rstrip()) + 1))
                    open_ = False
                if open_:
                    paragraphs[-1].append((at, end))
                else:
                    paragraphs.append([(at, end)])
                open_ = not text.startswith("#")
        at = end
    if fence:
        code.append((start, len(body)))
    return code, paragraphs


def code_ranges(body: str) -> list[tuple[int, int]]:
    """Fenced blocks, indented blocks and inline code, as character ranges in order."""
    if not _MAYBE_CODE.search(body):
        return []
    out, paragraphs = _blocks(body)
    for lines in paragraphs:
        lo, hi = lines[0][0], lines[-1][1]
        if "`" in body[lo:hi]:
            out += [(lo + m.start(), lo + m.end()) for m in _SPAN.finditer(body[lo:hi])]
    return sorted(out)


def _inside(ranges, at: int) -> bool:
    return any(lo <= at < hi for lo, hi in ranges)


def wikilinks(body: str, ranges=None) -> list[dict]:
    """Links in order: target, anchor, alias, character span, and whether it stands in code."""
    ranges = code_ranges(body) if ranges is None else ranges
    out = []
    for m in _WIKI.finditer(body):
        left, bar, alias = m.group(1).partition("|")
        target, sharp, anchor = left.partition("#")
        if target.strip():
            out.append(
                {
                    "target": target.strip(), "anchor": anchor.strip() if sharp else None, "alias": alias.strip() if bar else None,
                    "start": m.start(), "end": m.end(), "masked": _inside(ranges, m.start()),
                }
            )
    return out


def normalize_path(path: str) -> str | None:
    """'.' and '..' resolved; None when nothing is left or the path leaves the root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) or None


def path_links(body: str, rel_path: str, prefix: str = "", ranges=None) -> list[dict]:
    """Markdown links to .md files, relative or from the root, outside code; shaped as ``wikilinks``."""
    ranges = code_ranges(body) if ranges is None else ranges
    out = []
    for m in _MDLINK.finditer(body):
        href, sharp, anchor = m.group(3).partition("#")
        if m.group(1) or not href.endswith(".md") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) or _inside(ranges, m.start()):
            continue
        full = normalize_path(href.lstrip("/") if href.startswith("/") else posixpath.join(posixpath.dirname(rel_path), href))
        target = (full or "").removeprefix(prefix).removesuffix(".md")
        if target:
            out.append(
                {
                    "target": target, "anchor": anchor.strip() or None, "alias": m.group(2).strip() or None,
                    "start": m.start(), "end": m.end(), "masked": False,
                }
            )
    return out


def headings(body: str, ranges=None) -> list[tuple[int, str, int]]:
    """(level, text, start) of headings outside code, underlined ones too."""
    ranges = code_ranges(body) if ranges is None else ranges
    out = [(len(m.group(1)), _plain(m.group(2) or ""), m.start()) for m in _HEADING.finditer(body) if not _inside(ranges, m.start())]
    if _UNDERLINE.search(body):
        for lines in _blocks(body)[1]:
            for i, (lo, hi) in enumerate(lines):
                line = body[lo:hi].strip()
                if i and _UNDERLINE.fullmatch(body[lo:hi].rstrip("\r\n")):
                    first = lines[0][0]
                    if not body[first:hi].lstrip().startswith((">", "|")) and not _ITEM.match(body[first:]):
                        out.append((1 if line[0] == "=" else 2, _plain(" ".join(body[first:lo].split())), first))
                    break
    return sorted(out, key=lambda h: h[2])


def _plain(text: str) -> str:
    """A heading's words without code ticks, emphasis and link targets."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text.replace("`", ""))
    return re.sub(r"(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", text).strip()


def tags_in(body: str, ranges=None) -> list[str]:
    ranges = code_ranges(body) if ranges is None else ranges
    return [m.group(1) for m in _TAG.finditer(body) if not _inside(ranges, m.start(1))]


def truncate_bytes(text: str, cap: int) -> str:
    return text.encode()[: max(cap, 0)].decode("utf-8", "ignore")


def find_verbatim(text: str, needle: str) -> str | None:
    """The stretch of text that equals the needle up to white space."""
    words = needle.split()
    m = re.search(r"\s+".join(map(re.escape, words)), text) if words else None
    return m.group() if m else None


def extract_json(text: str) -> str | None:
    """The first balanced object or array; quotes are respected."""
    for m in re.finditer(r"[{\[]", text):
        stack, quoted, skip = [], False, False
        for i in range(m.start(), len(text)):
            ch = text[i]
            if quoted:
                quoted, skip = skip or ch != '"', not skip and ch == "\\"
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]":
                if stack.pop() != ch:
                    break
                if not stack:
                    return text[m.start() : i + 1]
        return None
    return None


def repair_json(text: str) -> str | None:
    """A broken-off reply cut back to its last complete element and closed."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    stack, opens, marks, quoted, skip = [], [], [], False, False
    for i in range(at, len(text)):
        ch = text[i]
        if quoted:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
            opens.append((i + 1, "".join(reversed(stack))))
        elif ch in "}]" and stack:
            stack.pop()
            marks.append((i + 1, "".join(reversed(stack))))
        elif ch == "," and stack:
            marks.append((i, "".join(reversed(stack))))
    for end, close in [*reversed(marks), *reversed(opens)]:
        candidate = text[at:end] + close
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None


def parse_reply(text: str | None):
    """The value of a model's JSON reply, repaired where it broke off; [{...}] gives its object."""
    if not text:
        return None
    for candidate in (extract_json(text), repair_json(text)):
        if candidate:
            try:
                v = json.loads(candidate)
            except ValueError:
                continue
            return v[0] if isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict) else v
    return None


def tolerant_items(v) -> list:
    """The items of a list, of a keyed map (in order of numeric keys) or of a text of lines without their markers."""
    if v is None:
        return []
    if isinstance(v, dict):
        return [x for _, x in sorted(v.items(), key=lambda p: (0, int(p[0]), "") if p[0].isdigit() else (1, 0, p[0]))]
    if isinstance(v, str):
        return [t for t in (re.sub(r"^\s*(?:[-*] |\d+[.)] )", "", line).strip() for line in v.splitlines()) if t]
    return v if isinstance(v, list) else [v]


def tolerant_list(v) -> list[str]:
    """The texts of ``tolerant_items``; of an object its text, name or claim."""
    flat = (x.get("text") or x.get("name") or x.get("claim") if isinstance(x, dict) else x for x in tolerant_items(v))
    return [s for s in (as_text(x) for x in flat) if s and s.strip()]


def add_list_item(text: str, field: str, item: str) -> str:
    """The file with item in a frontmatter list; block lists, flow lists and missing keys; idempotent."""
    block, _ = split_frontmatter(text)
    if block is None:
        raise ValueError("the file has no frontmatter")
    value = yaml_value(block)
    if isinstance(value, dict) and item in as_list(value.get(field)):
        return text
    start = text.index("\n") + 1
    lines = block.split("\n")
    at = max((i for i, line in enumerate(lines) if re.match(rf"{re.escape(field)}\s*:", line)), default=-1)
    if at < 0:
        lines[-1:] = [f"{field}:", f"  - {item}", lines[-1]]
    else:
        rest = lines[at].split(":", 1)[1].strip()
        if rest.startswith("["):
            inner = rest[1 : rest.rindex("]")].strip()
            lines[at] = f"{field}: [{inner + ', ' if inner else ''}{item}]"
        elif rest:
            lines[at : at + 1] = [f"{field}:", f"  - {rest}", f"  - {item}"]
        else:
            end, pad = at + 1, "  "
            while end < len(lines) and re.match(r"\s*- ", lines[end]):
                pad = lines[end][: lines[end].index("-")]
                end += 1
            lines.insert(end, f"{pad}- {item}")
    return text[:start] + "\n".join(lines) + text[start + len(block) :]


def set_scalar(text: str, field: str, value: str) -> str:
    block, _ = split_frontmatter(text)
    if block is None:
        raise ValueError("the file has no frontmatter")
    start = text.index("\n") + 1
    lines = block.split("\n")
    at = max((i for i, line in enumerate(lines) if re.match(rf"{re.escape(field)}\s*:", line)), default=-1)
    if at < 0:
        lines.insert(len(lines) - 1, f"{field}: {value}")
    else:
        lines[at] = f"{field}: {value}"
    return text[:start] + "\n".join(lines) + text[start + len(block) :]


def position_of(text: str, byte: int) -> tuple[int, int]:
    """(line, UTF-16 column) of a byte offset."""
    head = text.encode()[:byte].decode("utf-8", "ignore")
    line = head.count("\n")
    return line, len(head[head.rfind("\n") + 1 :].encode("utf-16-le")) // 2


def offset_of(text: str, line: int, column: int) -> int:
    """Byte offset of (line, UTF-16 column); clamped to the line's end."""
    rows = text.split("\n")
    if line >= len(rows):
        return len(text.encode())
    unit, n = 0, 0
    for ch in rows[line]:
        if unit >= column:
            break
        unit += 2 if ord(ch) > 0xFFFF else 1
        n += len(ch.encode())
    return sum(len(r.encode()) + 1 for r in rows[:line]) + n


def chunk_body(body: str, cap: int = 28_000) -> list[str]:
    """A body in chunks of at most cap bytes: cut before '## ', packed greedily, blanks dropped. A short body is one chunk as it is."""
    if len(body.encode()) <= cap:
        return [body]
    out, cur, room = [], "", cap
    for part in re.split(r"(?<=\n)(?=## )", body):
        while len(part.encode()) > cap:
            if cur:
                out.append(cur)
                cur = ""
            head = truncate_bytes(part, cap)
            out.append(head)
            part = part[len(head) :]
        if len((cur + part).encode()) > room:
            out.append(cur)
            cur = ""
        cur += part
    out.append(cur)
    return [c for c in out if c.strip()]


NOTE = (
    "path string, title string, kind string, status string, created string, updated string, tags array<string>, body_text string, "
    "body_hash string, frontmatter_json string, fields array<struct<field: string, value: string>>, "
    "links array<struct<target: string, anchor: string, alias: string, start: int, end: int, masked: boolean>>, "
    "headings array<struct<level: int, text: string, start: int>>"
)


def parse_file(path: str, text: str, edge_fields: tuple[str, ...] = (), names: dict | None = None, inline: bool = True, prefix: str | None = None, want: frozenset | None = None) -> dict:
    """A note's columns that come from its text: all, or those wanted. A prefix, if only '', asks for markdown path links, too."""
    need = lambda *columns: want is None or not want.isdisjoint(columns)
    names = {"title": "title", "kind": "kind", "status": "status", "created": "created", "updated": "updated", "tags": "tags"} | (names or {})
    block, body = split_frontmatter(text)
    front = yaml_value(block) if need("title", "kind", "status", "created", "updated", "tags", "frontmatter_json", "fields") else None
    get = front.get if isinstance(front, dict) else lambda k: None
    ranges = code_ranges(body) if need("links", "headings") or inline and need("tags") else []
    links = [*wikilinks(body, ranges), *(path_links(body, path, prefix, ranges) if prefix is not None else ())] if need("links") else []
    tags = as_list(get(names["tags"])) if get(names["tags"]) is not None else []
    for t in tags_in(body, ranges) if inline and need("tags") else ():
        if t not in tags:
            tags.append(t)
    return {
        "path": path, "title": as_text(get(names["title"])), "kind": as_text(get(names["kind"])), "status": as_text(get(names["status"])),
        "created": as_text(get(names["created"])), "updated": as_text(get(names["updated"])), "tags": tags, "body_text": body,
        "body_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if need("body_hash") else None,
        "frontmatter_json": json.dumps(front, ensure_ascii=False),
        "fields": [{"field": f, "value": v} for f in edge_fields for v in as_list(get(f)) if get(f) is not None],
        "links": links, "headings": [{"level": l, "text": t, "start": s} for l, t, s in headings(body, ranges)] if need("headings") else [],
    }


def parsed_notes(
    files: DataFrame, edge_fields: tuple[str, ...] = (), names: dict | None = None, inline: bool = True, prefix: str | None = None, want: tuple[str, ...] | None = None
) -> DataFrame:
    """Notes of files ``(rel_path, text)``: all columns, or path and those wanted, and only what these need is parsed.

    A null text is an empty file, a null path is left out. Files of one small table are spread over the cores by
    the caller, at the scan.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(NOTE)
    if want is not None:
        shape = StructType([f for f in shape if f.name == "path" or f.name in want])
        want = frozenset(shape.names)
    schema = to_arrow_schema(shape)

    def run(batches):
        for b in batches:
            rows = [parse_file(p, t or "", edge_fields, names, inline, prefix, want) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return files.where("rel_path is not null").select("rel_path", "text").mapInArrow(run, shape)


def parsed_replies(replies: DataFrame, column: str) -> DataFrame:
    """The rows whose reply ``parse_reply`` reads, with the reply as sound JSON; in Arrow batches."""
    at, schema = replies.columns.index(column), replies.schema

    def run(batches):
        for b in batches:
            got = [parse_reply(x) for x in b.column(at).to_pylist()]
            out = pa.array([None if v is None else json.dumps(v) for v in got], pa.string())
            yield b.set_column(at, column, out).filter(pa.array([v is not None for v in got], pa.bool_()))

    return spread(replies).mapInArrow(run, schema)


def reply_state(text: str | None) -> str:
    """'whole' for a reply that parses as it stands or in its wrapping, 'repaired', or 'none'."""
    if not text or parse_reply(text) is None:
        return "none"
    return "whole" if extract_json(text) else "repaired"


def reply_states(replies: DataFrame, column: str) -> DataFrame:
    """The rows with the ``state`` of their reply in its place."""
    at = replies.columns.index(column)
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f if i != at else StructField("state", StringType()) for i, f in enumerate(replies.schema)])

    def run(batches):
        for b in batches:
            states = pa.array([reply_state(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([states if i == at else b.column(i) for i in range(b.num_columns)], names=schema.names)

    return spread(replies).mapInArrow(run, schema)


def chunked(rows: DataFrame, column: str, cap: int = 28_000) -> DataFrame:
    """``(rel_path, synced_at, chunk, chunk_text, _row)`` of bodies: one row for each chunk; _row tells repeated rows apart."""
    from pyspark.sql import functions as F

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for path, at, text, row in zip(*(b.column(i).to_pylist() for i in range(4))):
                for i, t in enumerate(chunk_body(text or "", cap)):
                    for col, v in zip(out, (path, at, i, t, row)):
                        col.append(v)
            types = [b.column(0).type, b.column(1).type, pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["rel_path", "synced_at", "chunk", "chunk_text", "_row"])

    at = dict(rows.dtypes)["synced_at"]
    source = rows.select("rel_path", "synced_at", column, F.monotonically_increasing_id().alias("_row"))
    return spread(source).mapInArrow(run, f"rel_path string, synced_at {at}, chunk int, chunk_text string, _row long")


def edited(files: DataFrame, lists: dict[str, str], scalars: dict[str, str]) -> DataFrame:
    """``(rel_path, text)`` of files with items added to frontmatter lists and scalars set; files without frontmatter are left out."""

    def run(batches):
        for b in batches:
            paths, out = [], []
            for path, text in zip(b.column("rel_path").to_pylist(), b.column("text").to_pylist()):
                try:
                    for k, v in lists.items():
                        text = add_list_item(text, k, v)
                    for k, v in scalars.items():
                        text = set_scalar(text, k, v)
                except ValueError:
                    continue
                paths.append(path)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], names=["rel_path", "text"])

    return files.where("rel_path is not null and text is not null").select("rel_path", "text").mapInArrow(run, "rel_path string, text string")
