"""The scanner on texts of both syntaxes, and its tables."""

from lodestone.operators import scopes as S

PYTHON = '''"""class Not: def not_this(): { """
import os

class Outer(Base):
    """doc with } and def fake():"""
    x = {"a": [1, 2], 'b': "class No:"}

    def first(self, a,
              b=(1, {2: 3})) -> dict[str, int]:
        if a:  # second( {
            return second(
    b)
        def inner():
            return first(inner2())
        return inner()

    class Nested:
        def first(self): return 1

async def second(x):
\treturn Outer().first(x)
total = second(3)
'''
BRACES = """/* class No { */
class Shape extends Base {
  area(x) { return "}" + '{' + `}` + x; }
}
function outer(a, b = [1, {c: 2}]): Map<string, number> {
  // } function no() {
  function inner() { return outer(1); }
  const arrow = async (x) => { return inner() + helper(x); };
  if (a) { helper(a); }
}
function helper(x)
{
  return x;
}
let open = function () { helper(
"""


def told(text):
    found, calls = S.scanned(text)
    names = [d[1] for d in found]
    rows = [(d[0], d[1], d[4], names[d[5]] if d[5] >= 0 else None) for d in found]
    return rows, [(c, names[k] if k >= 0 else None) for c, k in calls], {d[1]: text[d[2] : d[3]] for d in found}


def test_indentation():
    rows, calls, text = told(PYTHON)
    assert rows == [("class", "Outer", 0, None), ("function", "first", 1, "Outer"), ("function", "inner", 2, "first"), ("class", "Nested", 1, "Outer"), ("function", "first", 2, "Nested"), ("function", "second", 0, None)]
    assert calls == [("second", "first"), ("first", "inner"), ("inner2", "inner"), ("inner", "first"), ("Outer", "second"), ("first", "second"), ("second", None)]
    assert text["inner"].startswith("def inner") and text["inner"].endswith("first(inner2())") and text["second"].endswith(".first(x)") and "total" not in text["second"]


def test_braces():
    rows, calls, text = told(BRACES)
    assert rows == [("class", "Shape", 0, None), ("function", "outer", 0, None), ("function", "inner", 1, "outer"), ("function", "arrow", 1, "outer"), ("function", "helper", 0, None), ("function", "open", 0, None)]
    assert ("outer", "inner") in calls and ("inner", "arrow") in calls and ("helper", "arrow") in calls and ("helper", "outer") in calls and ("no", "outer") not in calls
    assert text["outer"].endswith("helper(a); }\n}") and text["helper"].endswith("return x;\n}") and text["Shape"].endswith("x; }\n}")


def test_odd_texts():
    for text in ("", "}", "{{{", "def", "def x", "class A", "'", '"""', "function f(", "def f(:\n", "x = '\\", "/* never", "def a():"):
        found, _ = S.scanned(text)
        assert all(0 <= d[2] <= d[3] <= len(text) for d in found)
    assert S.blanked("a 'b\\'c' # d\ne") == "a" + " " * 11 + "\ne"


def test_tables(spark):
    df = spark.createDataFrame([(1, PYTHON), (2, BRACES), (3, None), (4, "")], "file long, text string")
    rows = {(r["file"], r["name"], r["depth"], r["parent"]) for r in S.definitions(df).collect()}
    assert (1, "inner", 2, "first") in rows and (2, "arrow", 1, "outer") in rows and len(rows) == 12
    got = {(r["file"], r["name"], r["uses"]): r["n"] for r in S.calls(df).collect()}
    assert got[2, "outer", "helper"] == 1 and got[1, "second", "first"] == 1 and (1, "first", "inner2") not in got
