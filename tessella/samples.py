"""Samples of code and what their outlines must be: for each language, snippets that stand alone,
and for each the nodes (parent, title, type, depth, line, metadata) by hand-checked rules of the
language; {k} stands for a key.  A sample file has some of the snippets, so files differ."""

SAMPLES: dict[str, tuple[str, list[tuple[tuple[str, ...], list[tuple]]]]] = {
    "ts": ('', [
        (('@Dec({ a: 1 })', 'export abstract class A{k}<T> extends B {', '  private static readonly x: Map<string, number> = new Map();', '  protected abstract go<U>(a?: U, b = 1, ...c: string[]): Promise<U>;', '  @Inj() public async run({ p, q }: P): Promise<void> {}', '  constructor(private readonly z: number) {}', '}'), [
            (None, 'A{k}', 'class', 1, 2, '{"isAbstract":true,"typeParameters":"<T>","decorators":["@Dec({ a: 1 })"]}'),
            (0, 'x', 'property', 2, 3, '{"visibility":"private","isStatic":true,"dataType":"Map<string, number>"}'),
            (0, 'go', 'method', 2, 4, '{"visibility":"protected","isAbstract":true,"parameters":[{"name":"a","type":"U","optional":true},{"name":"b","optional":true,"defaultValue":"1"},{"name":"...c","type":"string[]"}],"returnType":"Promise<U>","typeParameters":"<U>"}'),
            (0, 'run', 'method', 2, 5, '{"visibility":"public","parameters":[{"name":"{ p, q }","type":"P"}],"returnType":"Promise<void>"}'),
            (0, 'constructor', 'method', 2, 6, '{"parameters":[{"name":"z","type":"number"}]}'),
        ]),
        (('const f{k} = async <T>(a: T, [b, c]: T[]): Promise<T> => a;',), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a","type":"T"},{"name":"[b, c]","type":"T[]"}],"returnType":"Promise<T>","typeParameters":"<T>"}'),
        ]),
        (('export function g{k}(a?: number): a is number { return true; }',), [
            (None, 'g{k}', 'function', 1, 1, '{"parameters":[{"name":"a","type":"number","optional":true}],"returnType":"a is number"}'),
        ]),
        (('interface I{k} { readonly m: string; go?(x: number): void }',), [
            (None, 'I{k}', 'interface', 1, 1, None),
        ]),
        (('type U{k} = A | B;', 'enum E{k} { A = 1, B }'), [
            (None, 'U{k}', 'type', 1, 1, None),
            (None, 'E{k}', 'enum', 1, 2, None),
        ]),
    ]),
    "js": ('', [
        (('const f{k} = (a, b = [1, 2], ...rest) => a;',), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a"},{"name":"b","optional":true,"defaultValue":"[1, 2]"},{"name":"...rest"}]}'),
        ]),
        (("exports.g{k} = function ({ a, b }, c = 'x') { return a; };",), [
            (None, 'g{k}', 'function', 1, 1, '{"parameters":[{"name":"{ a, b }"},{"name":"c","optional":true,"defaultValue":"\'x\'"}]}'),
        ]),
        (('class K{k} {', '  static m() {}', '  async n(x) {}', '}'), [
            (None, 'K{k}', 'class', 1, 1, None),
            (0, 'm', 'method', 2, 2, '{"isStatic":true,"parameters":[]}'),
            (0, 'n', 'method', 2, 3, '{"parameters":[{"name":"x"}]}'),
        ]),
        (('function h{k}(a) {}',), [
            (None, 'h{k}', 'function', 1, 1, '{"parameters":[{"name":"a"}]}'),
        ]),
    ]),
    "py": ('', [
        (('class A{k}(B, C[int], metaclass=M):', '    x: int = 1', "    _y: str = ''", '    __z = 3', '    def __init__(self, a: int = 1, *args: str, b, **kw): pass', '    def __hidden(self): pass', '    @classmethod', '    def make(cls, x): pass'), [
            (None, 'A{k}', 'class', 1, 1, '{"bases":["B","C[int]","metaclass=M"]}'),
            (0, 'x', 'property', 2, 2, '{"visibility":"public","dataType":"int"}'),
            (0, '_y', 'property', 2, 3, '{"visibility":"protected","dataType":"str"}'),
            (0, '__z', 'property', 2, 4, '{"visibility":"private"}'),
            (0, '__init__', 'method', 2, 5, '{"visibility":"public","parameters":[{"name":"a","type":"int","optional":true,"defaultValue":"1"},{"name":"*args","type":"str"},{"name":"b"},{"name":"**kw"}]}'),
            (0, '__hidden', 'method', 2, 6, '{"visibility":"private","parameters":[]}'),
            (0, 'make', 'method', 2, 8, '{"visibility":"public","parameters":[{"name":"x"}]}'),
        ]),
        (("async def f{k}(a: 'T', b: int = 2, *, c) -> Dict[str, int]:", '    pass'), [
            (None, 'f{k}', 'function', 1, 1, '{"visibility":"public","parameters":[{"name":"a","type":"\'T\'"},{"name":"b","type":"int","optional":true,"defaultValue":"2"},{"name":"*"},{"name":"c"}],"returnType":"Dict[str, int]","isAsync":true}'),
        ]),
        (('def _g{k}(a=None):', '    return a'), [
            (None, '_g{k}', 'function', 1, 1, '{"visibility":"protected","parameters":[{"name":"a","optional":true,"defaultValue":"None"}]}'),
        ]),
    ]),
    "java": ('', [
        (('public abstract class A{k}<T> extends B implements C {', '  protected static final Map<String, T> m = null;', '  int plain;', '  private synchronized <U> List<U> go(final U a, int... b) throws E { return null; }', '  abstract void no();', '}'), [
            (None, 'A{k}', 'class', 1, 1, '{"visibility":"public","isAbstract":true}'),
            (0, 'm', 'field', 2, 2, '{"visibility":"protected","isStatic":true,"dataType":"Map<String, T>"}'),
            (0, 'plain', 'field', 2, 3, '{"dataType":"int"}'),
            (0, 'go', 'method', 2, 4, '{"visibility":"private","parameters":[{"name":"a","type":"U"},{"name":"int... b"}],"returnType":"List<U>","typeParameters":"<U>"}'),
            (0, 'no', 'method', 2, 5, '{"isAbstract":true,"parameters":[],"returnType":"void"}'),
        ]),
        (('interface I{k} { int go(String s); }',), [
            (None, 'I{k}', 'interface', 1, 1, None),
            (0, 'go', 'method', 2, 1, '{"parameters":[{"name":"s","type":"String"}],"returnType":"int"}'),
        ]),
        (('enum E{k} { A, B; public int x; }',), [
            (None, 'E{k}', 'enum', 1, 1, None),
            (0, 'A', 'enum-value', 2, 1, None),
            (0, 'B', 'enum-value', 2, 1, None),
            (0, 'x', 'field', 2, 1, '{"visibility":"public","dataType":"int"}'),
        ]),
    ]),
    "cs": ('', [
        (('public abstract class A{k} {', '  protected static int x = 1, y;', '  private readonly string s;', '  public string Name { get; set; }', '  internal abstract Task<int> Go(ref int a, string b = "q");', '  A{k}(int z) {}', '}'), [
            (None, 'A{k}', 'class', 1, 1, '{"visibility":"public","isAbstract":true}'),
            (0, 'x', 'field', 2, 2, '{"visibility":"protected","isStatic":true,"dataType":"int"}'),
            (0, 's', 'field', 2, 3, '{"visibility":"private","dataType":"string"}'),
            (0, 'Name', 'property', 2, 4, '{"visibility":"public","dataType":"string"}'),
            (0, 'Go', 'method', 2, 5, '{"visibility":"internal","isAbstract":true,"parameters":[{"name":"a","type":"int"},{"name":"b","type":"string"}],"returnType":"Task<int>"}'),
            (0, 'A{k}', 'method', 2, 6, '{"parameters":[{"name":"z","type":"int"}]}'),
        ]),
        (('interface I{k} { void Go(); }',), [
            (None, 'I{k}', 'interface', 1, 1, None),
            (0, 'Go', 'method', 2, 1, '{"parameters":[],"returnType":"void"}'),
        ]),
        (('internal enum E{k} { A, B }',), [
            (None, 'E{k}', 'enum', 1, 1, '{"visibility":"internal"}'),
            (0, 'A', 'enum-value', 2, 1, None),
            (0, 'B', 'enum-value', 2, 1, None),
        ]),
    ]),
    "cpp": ('', [
        (('class A{k} {', '  int hidden;', 'public:', '  static const char* name(int a, double);', '  int& ref(int x = 1, int y);', 'protected:', '  T t;', '};'), [
            (None, 'A{k}', 'class', 1, 1, None),
            (0, 'hidden', 'field', 2, 2, '{"visibility":"private","dataType":"int"}'),
            (0, 't', 'field', 2, 7, '{"visibility":"protected","dataType":"T"}'),
        ]),
        (('struct S{k} { int a; void go(); };',), [
            (None, 'S{k}', 'struct', 1, 1, None),
            (0, 'a', 'field', 2, 1, '{"visibility":"public","dataType":"int"}'),
            (0, 'go', 'method', 2, 1, '{"visibility":"public","parameters":[],"returnType":"void"}'),
        ]),
        (('void* f{k}(char *p) { return 0; }',), [
        ]),
        (('enum E{k} { X, Y };',), [
            (None, 'E{k}', 'enum', 1, 1, None),
        ]),
    ]),
    "go": ('package p', [
        (('func (r *R{k}) hide(int, string) error { return nil }',), [
            (None, 'hide', 'method', 1, 1, '{"visibility":"private","parameters":[{"name":"","type":"int"},{"name":"","type":"string"}],"returnType":"error","receiver":"(r *R{k})"}'),
        ]),
        (('func Show{k}(a int, b ...string) (x int, err error) { return }',), [
            (None, 'Show{k}', 'function', 1, 1, '{"visibility":"public","parameters":[{"name":"a","type":"int"}],"returnType":"(x int, err error)"}'),
        ]),
        (('type I{k} interface { M(a int) }',), [
            (None, 'I{k}', 'interface', 1, 1, '{"visibility":"public"}'),
            (0, 'M', 'method', 2, 1, '{"visibility":"public","parameters":[{"name":"a","type":"int"}]}'),
        ]),
        (('const c{k} = 1',), [
            (None, 'c{k}', 'constant', 1, 1, None),
        ]),
        (('type T{k} struct {', '  Open string', '  shut int', '}'), [
            (None, 'T{k}', 'struct', 1, 1, '{"visibility":"public"}'),
            (0, 'Open', 'field', 2, 2, '{"visibility":"public","dataType":"string"}'),
            (0, 'shut', 'field', 2, 3, '{"visibility":"private","dataType":"int"}'),
        ]),
    ]),
    "rs": ('', [
        (('impl<T> A{k}<T> {', "  pub(crate) fn go(&mut self, a: &'a [T], _: u8) {}", '  fn no(self) -> Self { self }', '}'), [
            (None, 'go', 'function', 1, 2, '{"visibility":"public","parameters":[{"name":"&mut self"},{"name":"a","type":"&\'a [T]"},{"name":"_","type":"u8"}]}'),
            (None, 'no', 'function', 1, 3, '{"parameters":[{"name":"self"}],"returnType":"Self"}'),
        ]),
        (('pub const X{k}: u8 = 1;',), [
            (None, 'X{k}', 'constant', 1, 1, None),
        ]),
        (('pub trait T{k} { fn a(&self); }',), [
            (None, 'T{k}', 'trait', 1, 1, '{"visibility":"public"}'),
            (0, 'a', 'method', 2, 1, '{"parameters":[{"name":"&self"}]}'),
        ]),
        (('fn f{k}<T: A>(mut a: T, (b, c): (i32, u8)) -> Option<T> { None }',), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a","type":"T"},{"name":"(b, c)","type":"(i32, u8)"}],"returnType":"Option<T>"}'),
        ]),
    ]),
    "rb": ('', [
        (('def f{k}(a, b = {}, *c, d:, e: 1, **f, &g)', 'end'), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a"},{"name":"b","optional":true,"defaultValue":"{}"},{"name":"*c"},{"name":"d:"},{"name":"e: 1"},{"name":"**f"},{"name":"&g"}]}'),
        ]),
        (('class A{k}', '  def go?; end', '  X = 1', 'end'), [
            (None, 'A{k}', 'class', 1, 1, None),
            (0, 'go?', 'method', 2, 2, '{"parameters":[]}'),
        ]),
    ]),
    "php": ('<?php', [
        (('abstract class A{k} {', '  private static int $x = 1;', '  final protected static function go(?int $a, $b, string ...$c): ?static {}', '  abstract function no();', '}'), [
            (None, 'A{k}', 'class', 1, 1, None),
            (0, 'x', 'property', 2, 2, '{"visibility":"private","isStatic":true,"dataType":"int"}'),
            (0, 'go', 'method', 2, 3, '{"visibility":"protected","isStatic":true,"parameters":[{"name":"$a","type":"?int"},{"name":"$b"},{"name":"$c","type":"string"}],"returnType":"?static"}'),
            (0, 'no', 'method', 2, 4, '{"isAbstract":true,"parameters":[]}'),
        ]),
        (('interface I{k} { function go(); }',), [
            (None, 'I{k}', 'interface', 1, 1, None),
            (0, 'go', 'method', 2, 1, '{"parameters":[]}'),
        ]),
        (('function f{k}(array $a = [1, 2], $b = null): int { return 1; }',), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"$a","type":"array","optional":true,"defaultValue":"[1, 2]"},{"name":"$b","optional":true,"defaultValue":"null"}],"returnType":"int"}'),
        ]),
    ]),
    "kt": ('', [
        (('abstract class A{k}<T>(val x: Int) : B() {', '  protected abstract fun go(a: List<T>, b: Int = 1): Map<String, T>', '  internal val y: String = "q"', '}'), [
            (None, 'A{k}', 'class', 1, 1, '{"isAbstract":true}'),
            (0, 'go', 'method', 2, 2, '{"visibility":"protected","isAbstract":true,"parameters":[{"name":"a","type":"List<T>"},{"name":"b","type":"Int"}],"returnType":"Map<String, T>"}'),
            (0, 'y', 'property', 2, 3, '{"visibility":"internal"}'),
        ]),
        (('interface I{k} { fun z(): Int }',), [
            (None, 'I{k}', 'interface', 1, 1, None),
            (0, 'z', 'method', 2, 1, '{"parameters":[],"returnType":"Int"}'),
        ]),
        (('private fun ext{k}(s: String): Int = 1',), [
            (None, 'ext{k}', 'function', 1, 1, '{"visibility":"private","parameters":[{"name":"s","type":"String"}],"returnType":"Int"}'),
        ]),
        (('object O{k} { fun make() {} }',), [
            (None, 'O{k}', 'object', 1, 1, None),
            (0, 'make', 'method', 2, 1, '{"parameters":[]}'),
        ]),
    ]),
    "swift": ('', [
        (('public class A{k}: B {', '  private static var x: [Int] = []', '  open func go(to a: Int, _ b: String = "q") -> Int? { return nil }', '}'), [
            (None, 'A{k}', 'class', 1, 1, None),
            (0, 'x', 'property', 2, 2, None),
            (0, 'go', 'method', 2, 3, '{"visibility":"open","parameters":[{"name":"to","type":"Int"},{"name":"_","type":"String"}]}'),
        ]),
        (('extension A{k} { static func make() {} }',), [
            (None, 'A{k}', 'extension', 1, 1, None),
            (0, 'make', 'method', 2, 1, '{"isStatic":true,"parameters":[]}'),
        ]),
        (('actor C{k} {}',), [
            (None, 'C{k}', 'actor', 1, 1, None),
        ]),
        (('enum E{k} { case one, two }',), [
            (None, 'E{k}', 'enum', 1, 1, None),
            (0, 'one', 'enum-value', 2, 1, None),
        ]),
    ]),
    "scala": ('', [
        (('abstract class A{k}[T](x: T) {', '  protected def go[U](a: U, b: Int = 1)(implicit c: C): Option[U]', '  private val y: Int = 1', '}'), [
            (None, 'A{k}', 'class', 1, 1, None),
            (0, 'go', 'method', 2, 2, '{"visibility":"protected","parameters":[{"name":"a","type":"U"},{"name":"b","type":"Int"}],"returnType":"Option[U]"}'),
        ]),
        (('object O{k} { def main(args: Array[String]): Unit = {} }',), [
            (None, 'O{k}', 'object', 1, 1, None),
            (0, 'main', 'method', 2, 1, '{"parameters":[{"name":"args","type":"Array[String]"}],"returnType":"Unit"}'),
        ]),
        (('trait T{k} { private[this] def no: Int = 1 }',), [
            (None, 'T{k}', 'trait', 1, 1, None),
            (0, 'no', 'method', 2, 1, '{"visibility":"private[this]","parameters":[],"returnType":"Int"}'),
        ]),
    ]),
    "lua": ('', [
        (('local function f{k}(a, b, ...)', 'end'), [
            (None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a"},{"name":"b"},{"name":"..."}],"isLocal":true}'),
        ]),
        (('function M.sub.go{k}(self, x)', 'end'), [
            (None, 'go{k}', 'function', 1, 1, '{"parameters":[{"name":"self"},{"name":"x"}]}'),
        ]),
        (('function M:meth{k}(y) end',), [
            (None, 'meth{k}', 'function', 1, 1, '{"parameters":[{"name":"y"}]}'),
        ]),
    ]),
}
