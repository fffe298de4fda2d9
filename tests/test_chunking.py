import textwrap

from sparrowdex.chunking.parse import create_chunks, parse_file
from sparrowdex.chunking.python import MOST_ERRORS, error_lines
from sparrowdex.chunking.rows import is_test
from sparrowdex.functions.text import ModelTokens, quarter_tokens
from sparrowdex.operators.split import split_oversized
from sparrowdex.schema import CHUNK
from sparrowdex.settings import Settings


def by_symbol(path, text, **kw):
    return {r["symbol"]: r for r in parse_file(path, text.encode() if isinstance(text, str) else text, **kw)}


def test_python():
    text = textwrap.dedent('''
        import math
        from tides import harbour

        class Gauge(Sensor):
            """Water level at a pier."""
            unit: str = "cm"

            @classmethod
            def at_noon(cls, readings):
                \'\'\' Mean of the middle third. \'\'\'
                def middle(xs):
                    return sorted(xs)[len(xs) // 3 :]
                return harbour.mean(middle(readings))

        @schedule("hourly")
        async def sample(pier: int) -> float:
            return await harbour.read(pier)

        def test_level():
            return math.isclose(sample(3), 1.5)
    ''').lstrip()
    r = by_symbol("coast/levels.py", text)
    assert list(r) == ["coast/levels.py", "imports", "Gauge", "Gauge.at_noon", "sample", "test_level"]
    assert r["Gauge"]["content"].splitlines() == ["class Gauge(Sensor):", '    """Water level at a pier."""', 'unit: str = "cm"']
    assert (r["Gauge"]["start_line"], r["Gauge"]["end_line"]) == (4, 6)
    noon = r["Gauge.at_noon"]
    assert (noon["start_line"], noon["end_line"], noon["signature"], noon["docstring"]) == (8, 13, "def at_noon(cls, readings):", "Mean of the middle third.")
    assert noon["decorators"] == ["@classmethod"] and noon["class_name"] == noon["parent_symbol"] == "Gauge"
    assert noon["calls"] == ["harbour.mean", "len", "middle", "sorted"]
    assert noon["qualified_symbol"] == "coast.levels.Gauge.at_noon"
    assert r["sample"]["is_async"] and (r["sample"]["start_line"], r["sample"]["docstring"]) == (15, "")
    assert r["test_level"]["is_test"] and not noon["is_test"]
    head = r["coast/levels.py"]
    assert head["imports"] == ["import math", "from tides import harbour"]
    assert head["content"] == "file: coast/levels.py\nmodule: coast.levels\nimports:\nimport math\nfrom tides import harbour"
    assert noon["file_metadata_id"] == head["id"] and head["has_parse_errors"] is False


def test_docstrings_keep_what_is_between_the_quotes():
    for literal, want in (('"one"', "one"), ("'two '", "two"), ('""" three\n    more """', "three\n    more"), ('""', ""), ('"a" "b"', 'a" "b'), ('r"raw"', 'r"raw"')):
        r = by_symbol("d.py", f"def f():\n    {literal}\n")
        assert r["f"]["docstring"] == want


def test_what_counts_as_a_test():
    for path, symbol, want in (("tests/a.py", "f", True), ("x/tests/a.py", "f", True), ("x/test_a.py", "f", True), ("x/a.py", "K.test_f", True), ("x/contests/a.py", "f", False), ("x/a_test.py", "f", False), ("test_x/a.py", "f", False)):
        assert is_test(path, symbol) is want


def test_python_that_does_not_parse():
    text = "class Reef:\n    def depth(self):\n        return 1 +\n\n@tag\ndef chart(:\n    pass\n\nx = )\n"
    r = by_symbol("reef.py", text)
    assert r["reef.py"]["parse_error_lines"] == [3, 6, 9] and r["Reef.depth"]["chunk_type"] == "method"
    assert (r["chart"]["start_line"], r["chart"]["end_line"]) == (5, 7)
    assert all(r[f"parse_error:{n}"]["has_parse_errors"] for n in (3, 6, 9))
    assert any(x["chunk_type"] == "function" for x in parse_file("noise.py", b"\x00\x07\xfe def sound():\n    pass\n"))
    assert [x["chunk_type"] for x in parse_file("nothing.py", b"")] == ["file_metadata"]
    assert len(error_lines(")\n" * 500)) == MOST_ERRORS


def test_markdown_and_text():
    r = parse_file("guide.md", b"lost\n# Top\n\n```\n# no heading\n```\n### Deep ###\ntext\n# Top\n## Empty\n## Next\nbody")
    assert [(x["symbol"], x["start_line"], x["end_line"], x["heading_level"], x["parent_headings"]) for x in r] == [
        ("Top", 2, 6, 1, []), ("Deep", 7, 8, 3, ["Top"]), ("Top", 9, 9, 1, []), ("Empty", 10, 10, 2, ["Top"]), ("Next", 11, 12, 2, ["Top"]),
    ]
    assert parse_file("blank.md", b"  \n\n ") == [] == parse_file("blank.txt", b" \n\t\n")
    assert [x["symbol"] for x in parse_file("plain.md", b"no headings\r\nhere")] == ["Document"]
    (t,) = parse_file("a/b.TXT", b"\x00\xff one\r\ntwo")
    assert (t["start_line"], t["end_line"], t["content"]) == (1, 2, "\x00 one\ntwo")


JS = """import tide from "tide-tables";
export { port } from './ports';

/**
 * Draws charts of a coast.
 */
export class Plotter extends Canvas {
  /** Metres a pixel. */
  static SCALE = 12;
  #edge = /[/}]+/;

  async render(points, zoom) {
    return tide.project({ at: `${points}}` }, new Frame("}"));
  }

  get width() { return 640; }
  onClick = (e) => { return e; }
}

// Halves a distance.
export default function halve(d) {
  if (d) { return round(d) / 2; }
}

const locate = async (ship) => {
  return tide.lookup(ship, "port");
}, spare = 3;
function* waves() { yield 1; }
"""


def test_javascript():
    r = by_symbol("map/index.js", JS)
    assert list(r) == ["map/index.js", "imports", "Plotter", "Plotter.render", "Plotter.width", "halve", "locate"]
    assert r["imports"]["end_line"] == 2 and r["map/index.js"]["module"] == "map" and not r["halve"]["has_parse_errors"]
    assert r["Plotter"]["docstring"] == "Draws charts of a coast." and r["halve"]["docstring"] == "Halves a distance."
    assert r["Plotter"]["content"].splitlines()[:2] == ["class Plotter extends Canvas", "static SCALE = 12"]
    assert r["Plotter.render"]["calls"] == ["new Frame", "tide.project"] and r["Plotter.render"]["is_async"] and r["Plotter.render"]["kind"] == "method"
    assert r["Plotter.width"]["kind"] == "get" and r["locate"]["is_async"] and r["locate"]["calls"] == ["tide.lookup"]
    assert r["halve"]["calls"] == ["round"] and r["locate"]["signature"] == "locate = async (ship) => {"


TS = """export interface Buoy {
  mass: number;
}
export type Depth = number | null;
export enum Wind { Calm, Gale }
export class Fleet implements Group<Buoy> {
  near(d: Depth): Buoy | null {
    return null;
  }
}
"""


def test_typescript_and_errors():
    r = by_symbol("sea.ts", TS)
    assert [x["chunk_type"] for x in r.values()] == ["file_metadata", "ts_interface", "type_alias", "enum", "class", "method"]
    assert r["Fleet"]["signature"] == "class Fleet implements Group<Buoy>" and r["Fleet.near"]["signature"] == "near(d: Depth): Buoy | null"
    assert r["Buoy"]["signature"] == "interface Buoy" and r["Wind"]["signature"] == "enum Wind"
    torn = parse_file("torn.js", b"function moor( {\n  return [1;\n}\n/* no end\n")
    assert [x["start_line"] for x in torn if x["chunk_type"] == "parse_error"] == [1, 2, 4] and all(x["has_parse_errors"] for x in torn)
    assert not by_symbol("Sail.jsx", "function Sail({ name }) {\n  return <p>{name}</p>;\n}\n")["Sail"]["has_parse_errors"]


def loop_groups(counts, most, overlap):
    groups, now = [], []
    for i, c in enumerate(counts):
        if now and sum(counts[k] for k in now) + c > most:
            groups.append(now)
            back = []
            for k in reversed(now):
                if overlap <= 0 or (back and sum(counts[x] for x in back) + counts[k] > overlap):
                    break
                back.insert(0, k)
            now = back
        now = [*now, i]
    return groups + [now] if now else groups


def test_parts_follow_a_plain_loop(spark):
    cases = [([f"value {i}" for i in range(120)], 20, 4), (["x" * (i * 7 % 90) for i in range(80)], 40, 0), (["y" * 2000, "z"], 20, 8), (["w" * 300, "v" * 4, "u" * 90], 22, 30)]
    for k, (lines, most, overlap) in enumerate(cases):
        df = spark.createDataFrame([(str(k), "\n".join(lines), "function", 5, 4 + len(lines), k)], "id string, content string, chunk_type string, start_line int, end_line int, ord long")
        for c in ("is_chunk_part boolean", "part_index int", "part_count int", "parent_chunk_id string"):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(null as {kind}) {name}")
        got = sorted(split_oversized(df, most, overlap).collect(), key=lambda r: r.ord)
        want = loop_groups([max(1, len(x) // 4) for x in lines], most, overlap)
        assert [(r.start_line - 5, r.end_line - 5) for r in got] == [(g[0], g[-1]) for g in want]
        assert [r.content for r in got] == ["\n".join(lines[g[0] : g[-1] + 1]) for g in want]
        assert [r.id for r in got] == [f"{k}:part:{i + 1}" for i in range(len(want))]


def test_counts_made_in_python_give_the_same_parts(spark):
    rows = [(str(k), "\n".join("w" * (k * i % 50) for i in range(k)), "function", 1, k, k) for k in (1, 9, 40)]
    df = spark.createDataFrame(rows, "id string, content string, chunk_type string, start_line int, end_line int, ord long")
    df = df.selectExpr("*", "cast(null as boolean) is_chunk_part", "cast(null as int) part_index", "cast(null as int) part_count", "cast(null as string) parent_chunk_id")
    model = ModelTokens(lambda: lambda texts: [max(1, len(t) // 4) for t in texts])
    shape = lambda count: sorted(map(tuple, split_oversized(df, 30, 8, count).select("id", "start_line", "end_line", "content").collect()))
    assert shape(model) == shape(quarter_tokens)


def test_create_chunks(spark):
    body = "\n".join(f"        depth_{i} = {i} * fathom" for i in range(30))
    files = [("sounding.py", f"class Lead:\n    def cast(self):\n{body}\n        return depth_0".encode()), ("look.css", b"a{}"), ("empty.txt", None)]
    got = create_chunks(spark.createDataFrame(files, "file_path string, content binary"), Settings(max_chunk_tokens=40, chunk_overlap_tokens=8))
    assert got.schema == CHUNK
    parts = sorted((r for r in got.collect() if r.chunk_type == "method"), key=lambda r: r.part_index)
    assert len(parts) > 1 and parts[0].start_line == 2 and parts[-1].end_line == 33 and {r.part_count for r in parts} == {len(parts)}
