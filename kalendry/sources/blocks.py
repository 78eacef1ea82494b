"""Text files of entries in block layout (`- key: value`, indented), read by many tasks and written back.

Spark's own text reader splits files between entries: an entry begins with "- " in the first column, so its separator
is a line break before that. Each entry is then parsed on its own by a stack of indents: maps and lists in lines, lists
of maps, [a, b] and {a: b} in one or more lines, plain, 'quoted' and "quoted" text over several lines, | literal and
> folded text with their endings, comments. Tags, anchors and tabs as indent are refused. Writing goes through Spark's
text writer, which commits a task's file when the task is done.

An entry that cannot be read fails the read with its file, the entry's first line, and the line and reason inside it.
"""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#:]*?(?::[^\s#:][^#:]*?)*|[-?:][^\s][^#:]*?)\s*:(?=\s|$)""")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_HEADER = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "e": "\x1b", "/": "/", "\\": "\\", '"': '"', " ": " ", "_": "\xa0", "N": "\x85"}
_PLAIN = re.compile(r"""(?![-?:](?:\s|$))[^\s,\[\]{}#&*!|>'"%@`](?:[^#:\n]|(?<!\s)#|:(?!\s|$))*""")


_COMMENT = re.compile(r"\s+#.*$")
_QUOTES = {"'": re.compile(r"'(?:[^']|'')*'", re.S), '"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S)}


class BlockError(ValueError):
    def __init__(self, line: int, why: str):
        super().__init__(f"line {line + 1}: {why}")


def _plain(text: str, typed: bool):
    """A plain value: nothing, a number or a truth value where typed, else the text."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if typed and text in ("true", "false"):
        return text == "true"
    if typed and _NUMBER.fullmatch(text):
        return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)
    return text


class _Entry:
    def __init__(self, text: str, typed: bool):
        self.lines, self.at, self.mark, self.typed = text.split("\n"), 0, 0, typed

    def fail(self, why: str):
        raise BlockError(self.mark, why)  # the line that next() found last

    def next(self) -> tuple[int, str] | None:
        """(indent, text) of the next line that holds something."""
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip()
            body = line.lstrip(" ")
            if body and body[0] != "#":
                self.mark = self.at
                if body[0] == "\t":
                    self.fail("a tab as indent")
                return len(line) - len(body), body
            self.at += 1
        return None

    def block(self, least: int):
        """The value that starts at the next line, if that is indented by least or more."""
        found = self.next()
        if found is None or found[0] < least:
            return None
        indent, body = found
        if body == "-" or body.startswith("- "):
            return self.list(indent)
        if _KEY.match(body):
            return self.map(indent)
        self.at += 1
        return self.value(body, least - 1)

    def list(self, indent: int) -> list:
        out = []
        while (found := self.next()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip(" ")
            if rest and rest[0] != "#":
                self.lines[self.at] = " " * (indent + len(found[1]) - len(rest)) + rest
                if rest[0] in "|>":
                    self.at += 1
                    out.append(self.text(rest, indent))
                    continue
            else:
                self.at += 1
            out.append(self.block(indent + 1))
        if found and found[0] > indent:
            self.fail("an indent that belongs to nothing")
        return out

    def map(self, indent: int) -> dict:
        out = {}
        while (found := self.next()) and found[0] == indent and (key := _KEY.match(found[1])):
            name, rest = key[1], found[1][key.end() :].lstrip()
            name = _quoted(name) if name[0] in "\"'" else name
            if name in out:
                self.fail(f"the key {name} twice")
            self.at += 1
            if not rest or rest[0] == "#":
                after = self.next()
                same = after and after[0] == indent and (after[1] == "-" or after[1].startswith("- "))
                out[name] = self.list(indent) if same else self.block(indent + 1)
            else:
                out[name] = self.text(rest, indent) if rest[0] in "|>" else self.value(rest, indent)
        if found and found[0] >= indent and not (found[0] == indent and found[1].startswith("-")):
            self.fail("neither a key nor a continuation")
        return out

    def value(self, text: str, indent: int):
        """A value that starts in a line already taken; lines indented deeper than indent continue it."""
        if text[0] in "\"'[{":
            while not (end := _closed(text)):
                if self.at >= len(self.lines):
                    self.fail("a quote or bracket stays open")
                text += "\n" + self.lines[self.at]
                self.at += 1
            if end < len(text) and re.match(r"\s*(#.*)?$", text[end:]) is None:
                self.fail("something after a quote or bracket")
            return _quoted(text[:end]) if text[0] in "\"'" else _Flow(text[:end], self).read()
        if text[0] in "&*!%@`":
            self.fail("tags, anchors and reserved marks are not read")
        parts = [_uncommented(text)]
        while parts[-1] == text and self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            if line.lstrip().startswith("#"):
                break
            text = line.strip()
            parts.append(_uncommented(text))
            self.at += 1
        if any(":" in p and re.search(r":(\s|$)", p) for p in parts):
            self.fail("a colon inside plain text")
        return _plain(_folded(parts), self.typed)

    def text(self, header: str, indent: int) -> str:
        """| keeps lines, > joins them; - drops the last line break, + keeps all empty lines."""
        match = _HEADER.fullmatch(header)
        if not match:
            self.fail("not a text header")
        style, ending, given = match[1], match[2] or match[4], match[3]
        lines = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            lines.append(line)
            self.at += 1
        first = next((x for x in lines if x.strip()), "")
        depth = indent + int(given) if given else len(first) - len(first.lstrip(" "))
        lines = [x[depth:] if x.strip() else x[depth:].rstrip(" ") for x in lines]
        end = len(lines)
        while end and not lines[end - 1]:
            end -= 1
        body, empty = lines[:end], len(lines) - end
        if style == "|":
            out = "\n".join(body)
        else:
            out = ""
            for i, x in enumerate(body):
                deeper = x[:1] in (" ", "\t")
                if i:
                    last = body[i - 1]
                    joins = bool(x) and bool(last) and not deeper and last[:1] not in (" ", "\t")
                    blank = not x or (not last and not deeper and any(body[:i]) and _before(body, i)[:1] not in (" ", "\t"))
                    out += " " if joins else "" if blank and x else "\n"
                out += x
        if ending == "-" or not body:
            return out if body or ending != "+" else "\n" * empty
        return out + "\n" * (1 + (empty if ending == "+" else 0) - (1 if ending == "+" and empty and self.at >= len(self.lines) else 0))


def _uncommented(line: str) -> str:
    return _COMMENT.sub("", line) if "#" in line else line


def _before(body: list[str], i: int) -> str:
    return next((x for x in reversed(body[:i]) if x), "")


def _folded(parts: list[str]) -> str:
    """Lines of one text joined: one break is a blank, an empty line a break."""
    out, breaks = parts[0], 0
    for p in parts[1:]:
        if p:
            out += ("\n" * breaks or " ") + p
            breaks = 0
        else:
            breaks += 1
    return out


def _closed(text: str) -> int:
    """Where the quote or bracket that text starts with is closed, just after it; 0 if it is not."""
    depth, i = 0, 0
    while i < len(text):
        c = text[i]
        if c == "'" or (c == '"'):
            match = _QUOTES[c].match(text, i)
            if not match:
                return 0
            i = match.end()
            if not depth:
                return i
            continue
        depth += (c in "[{") - (c in "]}")
        i += 1
        if not depth:
            return i
    return 0


def _quoted(text: str) -> str:
    if text[0] == '"' and text.isascii() and "\n" not in text and "\\" not in text:
        return text[1:-1]  # nothing to fold or to unescape
    lines = [x.strip(" ") if 0 < i else x for i, x in enumerate(text[1:-1].split("\n"))]
    lines = [x.rstrip(" ") if i < len(lines) - 1 else x for i, x in enumerate(lines)]
    body = _folded(lines)
    if text[0] == "'":
        return body.replace("''", "'")
    one = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "xuU" else _ESCAPE.get(m[1], m[1])
    out = re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


class _Flow:
    """[a, b] and {a: b}, nested."""

    def __init__(self, text: str, entry: _Entry):
        self.text, self.i, self.entry = re.sub(r"\s*\n\s*", " ", text), 0, entry

    def skip(self) -> str:
        while self.text[self.i] == " ":
            self.i += 1
        return self.text[self.i]

    def read(self):
        c = self.skip()
        if c in "[{":
            self.i += 1
            out = [] if c == "[" else {}
            while (d := self.skip()) not in "]}":
                if d == ",":
                    self.i += 1
                    continue
                item = self.read()
                if c == "{":
                    if self.skip() == ":":
                        self.i += 1
                        out[str(item)] = None if self.skip() in ",}" else self.read()
                    else:
                        out[str(item)] = None
                else:
                    out.append(item)
                if self.skip() not in ",]}":
                    self.entry.fail("items of a bracket without a comma")
            self.i += 1
            return out
        if c in "\"'":
            end = self.i + _closed(self.text[self.i :])
            out = _quoted(self.text[self.i : end])
            self.i = end
            return out
        match = re.compile(r"[^,\[\]{}:]+(?::[^\s,\[\]{}][^,\[\]{}:]*)*").match(self.text, self.i)
        if not match:
            self.entry.fail("a bracket that cannot be read")
        self.i = match.end()
        return _plain(match[0].strip(), self.entry.typed)


def parse(text: str, typed: bool = True):
    """The value of one entry's text, as dicts, lists, text, numbers and None; plain values stay text unless typed."""
    entry = _Entry(text.replace("\r\n", "\n"), typed)
    out = entry.block(0)
    if entry.next():
        entry.fail("something after the entry")
    return out


def _written(value) -> str:
    if value is None:
        return "null"
    return _text_written(value) if isinstance(value, str) else json.dumps(value)


@functools.lru_cache(maxsize=1 << 14)
def _text_written(value: str) -> str:
    plain = _PLAIN.fullmatch(value) and value == value.strip() and _plain(value, True) == value and not re.match(r"\d{4}-\d\d?-\d\d?$|(?i:true|false|yes|no|on|off|y|n)$|[-+.\d][\d_.:eExX+-]*$", value)
    return value if plain and value.isprintable() and not re.search(r"\s{2}|[^\S ]", value) else json.dumps(value, ensure_ascii=False).replace("\x7f", "\\x7f").replace("\x85", "\\N").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


@functools.lru_cache(maxsize=1 << 10)
def _name_written(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_](?:[\w .-]*[\w.-])?", name, re.A) else json.dumps(name)


def dump(value, indent: int = 0) -> str:
    """Block layout that parse() reads back to the same value; without a line break at the end."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        lines = []
        for k, v in value.items():
            inside = dump(v, indent + (2 if isinstance(v, (dict, list)) else 0))
            nested = isinstance(v, (dict, list)) and v
            name = _name_written(k)
            lines.append(f"{pad}{name}:" + ("\n" + inside if nested else " " + inside))
        return "\n".join(lines)
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}- " + (dump(v, indent + 2).lstrip(" ") if isinstance(v, (dict, list)) and v else dump(v)) for v in value)
    return "{}" if isinstance(value, dict) else "[]" if isinstance(value, list) else _written(value)


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every entry of the files in this order of files: ord (sorts entries as they stand), file, text. A missing file fails."""
    frames = []
    for number, path in enumerate(paths):
        text = spark.read.option("lineSep", "\n- ").text(path)
        places = F.struct(F.lit(number).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        frames.append(text.select(places.alias("ord"), F.lit(path).alias("file"), F.col("value").alias("text")))
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.union(frame)
    return rows.where(F.regexp_replace("text", r"(?m)^\s*#.*$", "").rlike(r"\S"))


def parsed(rows: DataFrame, typed: bool = True) -> DataFrame:
    """entries() with the VARIANT column entry: what each holds. Everything before a file's first entry but comments fails."""

    @F.pandas_udf("json string, error string")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            start = re.sub(r"\A(\s*(#.*)?\n)*", "", text)
            body = start[2:] if start.startswith("- ") else text
            try:
                value = parse("  " + body, typed)
                if not isinstance(value, dict):
                    raise BlockError(0, "no entry of keys")
                out.append((json.dumps(value, ensure_ascii=False), None))
            except BlockError as e:
                out.append((None, f"{body.strip().splitlines()[0][:200]!r}, {e}"))
        return pd.DataFrame(out, columns=["json", "error"])

    met = rows.withColumn("read", read("text"))
    said = F.concat(F.lit("a catalogue holds something that is no entry: "), "file", F.lit(", at "), "read.error")
    checked = F.when(F.col("read.error").isNotNull(), F.raise_error(said)).otherwise(F.col("read.json"))
    return met.withColumn("entry", F.parse_json(checked)).drop("read", "text")


def text_of(json_text: Column) -> Column:
    """A JSON object's text -> its entry, an empty line after it."""

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return pd.Series(["- " + dump(json.loads(v), 2).lstrip(" ") + "\n" for v in values], dtype="object")

    return written(json_text)


def write(rows: DataFrame, json_text: Column, folder: str, *keys: Column) -> None:
    """One entry a row in the order of keys, as text files whose names sort in that order."""
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
    sorted_.select(text_of(json_text).alias("value")).write.mode("overwrite").text(folder)
