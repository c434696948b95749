"""Definitions in code texts with their places, parents and depth, and what each one calls.

A scanner goes over a file once. Strings and comments are blanked first, so that no bracket or word in them counts. A
definition by braces ends where its own brace closes; one by indentation before the next line, outside brackets, that is
indented no further. A stack of open definitions tells the parent of each and the caller of each call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INERT = re.compile(r"'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|/\*.*?(?:\*/|\Z)|//[^\n]*|#[^\n]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.DOTALL)
_DEFINED = re.compile(r"\b(function|def|class)\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
#: Words before a parenthesis that call nothing.
WORDS = frozenset("if for while switch catch return elif else function def class and or not in with except lambda print".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


def blanked(text: str) -> str:
    """The text with strings and comments as blanks; lines and places stay."""
    return _INERT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _header(code: str, at: int) -> tuple[str, int]:
    """What opens a definition's body, a brace or a colon outside brackets, and where; blank if neither does."""
    depth = 0
    for k in range(at, len(code)):
        c = code[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c in "{:":
            return c, k
        elif depth <= 0 and c == ";":
            break
    return "", at


def _after_brace(pairs: dict[int, int], at: int, size: int) -> int:
    return pairs.get(at, size - 1) + 1


def _after_indent(code: str, start: int, body: int, deep: list[int]) -> int:
    """The end of a block whose header begins at start and ends at body: lines indented further, or inside brackets."""
    line = code.rfind("\n", 0, start) + 1
    own = len(code[line:start].expandtabs()) if not code[line:start].strip() else len(re.match(r"\s*", code[line:])[0].expandtabs())
    end = at = code.find("\n", body)
    if at < 0:
        return len(code)
    while at >= 0:
        stop = code.find("\n", at + 1)
        row = code[at + 1 : stop if stop >= 0 else len(code)]
        if row.strip() and not deep[at] and len(row[: len(row) - len(row.lstrip())].expandtabs()) <= own:
            return end
        if row.strip():
            end = stop if stop >= 0 else len(code)
        at = stop
    return end


def scanned(text: str) -> tuple[list[tuple], list[tuple]]:
    """Definitions (kind, name, start, stop, depth, parent's place in this list or -1) in order, and calls (callee, the
    place of the innermost definition around it or -1). Stops are exclusive."""
    code = blanked(text)
    pairs, stack, deep = {}, [], [0] * (len(code) + 1)
    for k, c in enumerate(code):
        if c in "([{":
            stack.append((c, k))
        elif c in _CLOSES and stack and stack[-1][0] == _CLOSES[c]:
            pairs[stack.pop()[1]] = k
        deep[k] = len(stack)
    found = []
    for m in _DEFINED.finditer(code):
        kind = "class" if m[1] == "class" else "function"
        opener, at = ("{", code.find("{", m.end())) if m[3] else _header(code, m.end())
        if m[1] == "function" and opener == ":":  # a return type stands before the brace
            opener, at = "{", code.find("{", at)
        if opener == "{" and at >= 0:
            stop = _after_brace(pairs, at, len(code))
        else:
            stop = _after_indent(code, m.start(), at, deep) if opener == ":" else m.end()
        found.append((kind, m[2] or m[3], m.start(), stop))
    out, open_ = [], []
    for kind, name, start, stop in found:
        while open_ and out[open_[-1]][3] <= start:
            open_.pop()
        out.append((kind, name, start, stop, len(open_), open_[-1] if open_ else -1))
        open_.append(len(out) - 1)
    starts = {m.start(2) if m[2] else m.start(3) for m in _DEFINED.finditer(code)}
    calls, open_, k = [], [], 0
    for m in _CALL.finditer(code):
        while k < len(out) and out[k][2] <= m.start():
            open_.append(k)
            k += 1
        open_ = [i for i in open_ if out[i][3] > m.start()]
        if m[1] not in WORDS and m.start() not in starts:
            calls.append((m[1], open_[-1] if open_ else -1))
    return out, calls


_ROWS = "kind string, name string, start int, stop int, depth int, place int, parent int"


def _scan(files: DataFrame, key: str) -> DataFrame:
    """One row a definition, and one of kind `call` a call, with the place of what holds it as parent."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                definitions, calls = scanned(text or "")
                rows += [(*d[:5], i, d[5]) for i, d in enumerate(definitions)]
                rows += [("call", name, None, None, None, None, holder) for name, holder in calls]
                at += [k] * (len(definitions) + len(calls))
            types = [pa.string(), pa.string(), *[pa.int32()] * 5]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, "kind", "name", "start", "stop", "depth", "place", "parent"])

    return files.select(key, F.col("text").cast("string")).mapInArrow(run, f"`{key}` {kind}, {_ROWS}")


def definitions(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, kind, name, start, stop, depth, parent): every definition of a file with its place in characters, how deep it
    lies, and the name of the one around it. A name that is defined twice has two rows. files: key (unique), text; null
    and empty texts have none."""
    found = _scan(files, key).where("kind <> 'call'")
    around = found.select(F.col(key).alias("__k"), F.col("place").alias("__p"), F.col("name").alias("__n"))
    both = found.join(around, (F.col(key) == F.col("__k")) & (F.col("parent") == F.col("__p")), "left")
    return both.select(key, "kind", "name", "start", "stop", "depth", F.col("__n").alias("parent"))


def calls(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, name, uses, n): how often a definition itself, not one inside it, calls another one of its file by name."""
    found = _scan(files, key)
    own = found.where("kind <> 'call'")
    made = found.where("kind = 'call' and parent >= 0").groupBy(key, "parent", F.col("name").alias("uses")).agg(F.count("*").alias("n"))
    known = made.join(own.select(key, F.col("name").alias("uses")).distinct(), [key, "uses"], "left_semi")
    by = own.select(key, F.col("place").alias("parent"), "name")
    return known.join(by, [key, "parent"]).where("name <> uses").groupBy(key, "name", "uses").agg(F.sum("n").alias("n"))
