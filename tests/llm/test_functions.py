import pytest

from graphloom.llm.functions import described, documented, functions, functions_of, is_trivial, keys, pairs, symbols

DOC = "Turns the raw entries into rows of the next layer."
CASES = {
    "py": f'''def a():
    """{DOC}"""
class C:
    @deco
    async def b(self,
                x: int = (1)) -> int:
        rQQQ{DOC}

        :param x: itQQQ
        def inner(y): "{DOC}"
        return 1
def c():
    # {DOC}
    f"""{DOC}"""
def d(): pass
s = """
def no():
    QQQ{DOC}QQQ
"""
'''.replace("QQQ", "'''"),
    "js": f'''// {DOC}
function a() {{}}
/* {DOC} */

function gap() {{}}
class C {{
  /** {DOC}
   */
  static async b(x) {{ return `function no() {{}}`; }}
  c() {{}}
}}
// {DOC}
export const d = async (x) => {{
  // {DOC}
  function inner() {{}}
}}
foo(); // {DOC}
const e = x => x;
''',
    "ts": f'''/** {DOC} */
@Traced()
export class K {{
  /** {DOC} */
  @Traced() @Other
  private async a<T>(x: T): Promise<{{ y: T }}> {{ return x; }}
}}
// {DOC}
export function b(x: string): void;
function c(): {{ a: number }} {{ return x; }}
''',
    "go": f'''package p

// a {DOC}
//
//nolint:errcheck
func a(x int, ys ...string) (int, error) {{ return f(func() {{}}) }}

/* {DOC} */
func (s *S) b() {{}}

// {DOC}

func c() {{}}
''',
    "java": f'''class A {{
  /** {DOC} */
  @Override
  @X(a = "/* no */")
  public List<String> a(final int x, Map<K, V> y) throws E {{ return f(x); }}
  // {DOC}
  A() {{}}
  int b() {{ return 1; }}
  abstract void c();
}}
''',
    "rs": f'''/// {DOC}
#[inline]
pub(crate) fn a<T: Clone>(x: &T) -> u8 {{ 1 }}
impl S {{
    /** {DOC} /* nested */ */
    fn b(&self) {{}}
}}
// rustfmt-skip
fn c() {{}}
''',
}
WANT = {
    "py": {("a", True), ("b", True), ("inner", True), ("c", False), ("d", False)},
    "js": {("a", True), ("gap", False), ("b", True), ("c", False), ("d", True), ("inner", True), ("e", False)},
    "ts": {("a", True), ("b", True), ("c", False)},
    "go": {("a", True), ("b", True), ("c", False)},
    "java": {("a", True), ("A", True), ("b", False), ("c", False)},
    "rs": {("a", True), ("b", True), ("c", False)},
}


@pytest.mark.parametrize("ext", CASES)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_functions_and_their_documentation(ext, end):
    found = functions_of(ext, CASES[ext].replace("\n", end))
    got = {(f.name, f.doc is not None and not is_trivial(f.doc, f.name, set(f.params))) for f in found}
    assert got == WANT[ext]


@pytest.mark.parametrize(
    ("doc", "name", "trivial"),
    [
        ("TODO: document this", "f", True), ("", "f", True), ("...", "f", True), ("Splits the stale stream.", "splitStaleStream", True), ("{@inheritDoc}", "f", True),
        ("@param x\n@return", "f", True), ("@param x the first of all entries", "f", False), (":param limit:\n:return:", "f", True), ("Args:\n    items:\n\nReturns:", "f", True),
        ("Parameters\n----------\nsource : object\n", "f", True), ("# Arguments\n\n* `opts` - the nested stream to start from", "f", False), ("one two three", "f", True), ("one two three four", "f", False),
        ("one two three four", "four", True), ("eslint-disable-next-line no-console in this one file", "f", True), ("Раньше было понятнее и короче", "f", False), ("結果はキューに依存してはいけません。", "f", False),
    ],
)
def test_trivial(doc, name, trivial):
    assert is_trivial(doc.split("\n"), name, {"x", "limit", "items", "source", "opts"}) is trivial


def test_operator(spark):
    rows = [
        (1, "r", "a.py", CASES["py"]), (1, "r", "a.py", CASES["py"]), (2, "r", "b.go", "broken"), (3, "r", "c.js", None), (4, "r", "d.py", ""), (5, "r", None, "x"),
        (6, "r", "i.ts", f"/** {DOC} */\nexport declare function load(a: string, b: number): void;\n"), (7, "r", "j.ts", "export function load(x: string, y: number): void { x; }\n"),
        (8, "r", "k.ts", "export function load(x: string): void { x; }\n"),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, path string, source string").selectExpr("*", "1 as name", "2 as start_line")
    got = sorted((r.file_id, r.start_line) for r in documented(files).collect())
    assert got == [(1, 0), (1, 4), (1, 9), (6, 1)]
    by = {(r.file_id, r.qname): r.description for r in pairs(files).collect()}
    assert by[7, "j::load"] == DOC and (8, "k::load") not in by and (1, "a::C::b") in by and (6, "i::load") not in by
    assert functions(files.limit(0)).collect() == []


def test_declarations_meet_definitions_by_qualified_name(spark):
    iface = "package {p};\n{i}interface {n} {{\n  /** {d} */\n  String get(String key);\n}}\n"
    impl = "package c;\n{i}class {n} {head} {{\n  {d}\n  public String get(String key) {{ return key; }}\n}}\n"
    one, two = "Looks the key up in memory first.", "Asks the remote service for the key."
    rows = [
        (1, "src/a/Store.java", iface.format(p="a", n="Store", d=one, i="")),
        (2, "src/b/Store.java", iface.format(p="b", n="Store", d=two, i="")),
        (3, "src/c/Mem.java", impl.format(n="Mem", head="implements Store", d="", i="import a.Store;\n")),
        (4, "src/c/Far.java", impl.format(n="Far", head="extends Base<String>", d="/** {@inheritDoc} */", i="")),
        (5, "src/c/Base.java", "package c;\nimport b.Store;\nabstract class Base<T> implements Store {\n}\n"),
        (6, "src/c/Other.java", impl.format(n="Other", head="", d="", i="")),
        (7, "src/c/Cmp.java", impl.format(n="Cmp", head="implements Store", d="", i="import java.util.Store;\n")),
        (8, "src/d/Quiet.java", iface.format(p="d", n="Quiet", d="TODO", i="")),
        (9, "src/d/Still.java", impl.format(n="Still", head="implements Quiet", d="", i="")),
        (10, "src/t.rs", f"trait T {{\n    /// {one}\n    fn get(&self) -> u8;\n}}\ntrait U {{\n    /// {two}\n    fn get(&self) -> u8;\n}}\nstruct S;\nimpl S {{\n    fn get(&self) -> u8 {{ 1 }}\n}}\nimpl T for S {{\n    fn get(&self) -> u8 {{ 1 }}\n}}\nimpl<X> U for S<X> {{\n    fn get(&self) -> u8 {{ 1 }}\n}}\n"),
        (11, "web/store.ts", f"export interface Store {{\n  /** {one} */\n  get(key: string): string;\n}}\n"),
        (12, "web/x/mem.ts", "import { Store as Kept } from '../store';\nexport class Mem implements Kept {\n  get(key: string): string { return key; }\n}\nexport class Free {\n  get(key: string): string { return key; }\n}\n"),
    ]
    files = spark.createDataFrame([(i, "r", p, s) for i, p, s in rows], "file_id bigint, repo string, path string, source string")
    got = {(r.file_id, r.start_line): r.description for r in pairs(files).collect()}
    assert got == {(3, 4): one, (4, 3): two, (10, 13): one, (10, 16): two, (12, 2): one}


def test_described_functions_come_from_the_joined_symbol_table(spark):
    one, two = "Looks the key up in memory first.", "Asks the remote service for the key."
    rows = [
        (1, "a.ts", f"interface A {{\n  /** {one} */\n  load(x: number): void;\n}}\ninterface B extends A {{\n}}\n"),
        (2, "b.ts", f"interface Z {{\n  /** {two} */\n  load(x: number): void;\n}}\n"),
        (3, "c.ts", "class C implements B {\n  load(x: number): void { x; }\n}\nclass D {\n  load(x: number): void { x; }\n}\n"),
        (4, "e.ts", "class E implements A, Z {\n  load(x: number): void { x; }\n}\n"),
        (5, "f.ts", f"/** {one} */\nfunction over(x: number): void;\nfunction over(x: string): void;\nfunction over(x: number): void {{ x; }}\n"),
        (6, "g.ts", f"class G implements A {{\n  /** {two} */\n  load(x: number): void {{ x; }}\n}}\nclass H implements A {{\n  /** TODO */\n  load(x: number): void {{ x; }}\n}}\n"),
        (7, "q/a.ts", f"interface Q {{\n  /** {one} */\n  load(x: number): void;\n}}\n"),
        (8, "r/a.ts", f"interface Q {{\n  /** {two} */\n  load(x: number): void;\n}}\n"),
        (9, "s/a.ts", "class S implements Q {\n  load(x: number): void { x; }\n}\n"),
        (10, "q/b.ts", "class Q implements Q {\n  load(x: number): void { x; }\n}\n"),
    ]
    files = spark.createDataFrame([(i, "r", p, s) for i, p, s in [*rows, rows[2]]], "file_id bigint, repo string, path string, source string")
    # what stands above a function, and what a type above its owner or a declaration of its own owner lends it: not to D,
    # which is of no such type, to E, whose types disagree, and to S, as there are two of that name
    own = [(1, 2), (2, 2), (5, 1), (6, 2), (7, 2), (8, 2)]
    lent = [(3, 1, 1, 2), (5, 3, 5, 1), (6, 6, 1, 2), (10, 1, 7, 2)]
    for found in (keys(files), symbols(files)):
        got = sorted((r.file_id, r.start_line, r.at_file, r.at_line) for r in described(found).collect())
        assert got == sorted([(*x, *x) for x in own] + lent)
    assert sorted(documented(files).collect()) == own
