import pytest

from navspark.sources.extract import EXTRACTORS, extract


def found(language, source):
    return [(s.name, s.kind, s.parent, s.visibility) for s in extract(language, source)]


def names(language, source):
    return [s.name for s in extract(language, source)]


@pytest.mark.parametrize("language", EXTRACTORS)
@pytest.mark.parametrize("source", ["", "\n\n", "// just words\n", "# just words\n", "}{)(][ '\"` /*", "\x00\x01 é日本", "((((" * 3000])
def test_nothing_from_nothing(language, source):
    assert extract(language, source) == []


def test_ruby_places():
    got = extract("ruby", "# gauges\nmodule Weather\n  class Barometer\n    def self.standard; new; end\n\n    def read\n      @hpa\n    end\n  end\n\n  module Units\n  end\nend\n")
    assert [(s.name, s.parent, s.line, s.end_line) for s in got] == [
        ("Weather", None, 2, 13), ("Barometer", "Weather", 3, 9), ("standard", "Weather::Barometer", 4, 4), ("read", "Weather::Barometer", 6, 8), ("Units", "Weather", 11, 12),
    ]


def test_ruby_scoped_class_names():
    assert found("ruby", "module Sea\n  class Tide::Table < Base\n    def rows = []\n  end\nend") == [
        ("Sea", "module", None, "public"), ("Table", "class", "Sea::Tide", "public"), ("rows", "method", "Sea::Tide::Table", "public"),
    ]


def test_ruby_class_level_calls():
    source = """class Voyage < Record
  belongs_to :captain, class_name: "Sailor", optional: true
  attr_writer :heading
  alias_method :course, :heading
  scope :finished, ->(port) { where(ended_in: port) }
  delegate :flag,
           to: :captain
  define_method("log_#{kind}") { |entry| entry }
  define_method :drift do |knots|
    knots * 2
  end
  crew.has_many :strangers
  validates :heading, presence: true
end
"""
    got = names("ruby", source)
    assert got == ["Voyage", "captain", "heading", "course", "finished", "flag", "drift"]


def test_ruby_sections_and_bodies():
    source = """class Winch
  def haul
    return if slack?
    lines.each_with_index do |l, n|
      puts 'end of line' unless n # end
    end
    note = <<-NOTE
      class Paper
      end
    NOTE
    until taut
      turn
    end
  end

  protected

  def turn; end
  private def brake = @brake
  def self.spare
    case size
    when 1 then if old then x end
    end
  rescue
    y
  end
end
class Winch
  def reopened_here
  end
end
"""
    assert found("ruby", source) == [
        ("Winch", "class", None, "public"), ("haul", "method", "Winch", "public"), ("turn", "method", "Winch", "protected"), ("brake", "method", "Winch", "private"),
        ("spare", "method", "Winch", "public"), ("Winch", "class", None, "public"), ("reopened_here", "method", "Winch", "public"),
    ]


def test_rust():
    source = """
pub struct Widget<T> { size: u32, t: T }
pub(crate) enum Shape { Round, Square }
union Bits { a: u32, b: f32 }
pub trait Render { fn render(&self) -> String; fn made() -> Self where Self: Sized { todo!() } }
impl<T: Clone> Widget<T> {
    pub fn new(size: u32) -> Self { let f = |x: u32| { fn inner() {} x }; unreachable!("fn nope() {{") }
    pub(crate) async fn resize(&mut self, n: u32) where T: Copy { self.size = n; }
}
impl<'a> fmt::Display for outer::Thing<'a> { fn fmt(&self, f: &mut F) -> R { Ok(()) } }
mod search;
mod outer { pub struct Store; impl<K> Store { pub const fn get(&self) -> [u8; 3] { [b'{', 1, 2] } } }
pub unsafe extern "C" fn raw() {}
const fn fixed() -> u8 { 1 }
/* fn hidden() {} */ // fn hidden() {}
"""
    assert found("rust", source) == [
        ("Widget", "struct", None, "public"), ("Shape", "enum", None, "crate"), ("Bits", "struct", None, "private"), ("Render", "trait", None, "public"),
        ("render", "method", "Render", "private"), ("made", "function", "Render", "private"), ("new", "function", "Widget", "public"), ("resize", "method", "Widget", "crate"),
        ("fmt", "method", "Thing", "private"), ("outer", "module", None, "private"), ("Store", "struct", "outer", "public"), ("get", "method", "outer::Store", "public"),
        ("raw", "function", None, "public"), ("fixed", "function", None, "private"),
    ]


def test_go():
    source = """package x
type (
	Widget struct { Size int }
	Alias = Widget
	Renderer interface {
		Render(w *Widget) string
		fmt.Stringer
	}
)
type Map[K comparable, V any] struct { m map[K]V }
func (w *Widget) Resize(n int) (int, error) { f := func() {}; f(); return n, nil }
func (m Map[K, V]) Get(k K) V { return m.m[k] }
func internal[T any](x T) interface{} { return `type Fake struct {}` }
func Exported() struct{ A int } { return struct{ A int }{1} }
"""
    assert found("go", source) == [
        ("Widget", "struct", None, "public"), ("Renderer", "trait", None, "public"), ("Render", "method", "Renderer", "public"), ("Map", "struct", None, "public"),
        ("Resize", "method", "Widget", "public"), ("Get", "method", "Map", "public"), ("internal", "function", None, "private"), ("Exported", "function", None, "public"),
    ]


PYTHON = """
class Client(Base):
    @property
    def url(self):
        def inner():
            pass
        return inner
    async def fetch(self): ...
    def __init__(self): pass
    class Meta:
        def deep(self): pass
if True:
    def _internal():
        pass
try:
    import x
except ImportError:
    def fallback(): pass
"""


@pytest.mark.parametrize("source", [PYTHON, PYTHON + "\ndef broken(:\n    pass\n"])
def test_python(source):
    got = found("python", source)
    want = [
        ("Client", "class", None, "public"), ("url", "method", "Client", "public"), ("fetch", "method", "Client", "public"), ("__init__", "method", "Client", "public"),
        ("Meta", "class", "Client", "public"), ("deep", "method", "Client.Meta", "public"), ("_internal", "function", None, "private"), ("fallback", "function", None, "public"),
    ]
    assert got[: len(want)] == want


def test_typescript():
    source = """
export abstract class Widget<T extends object> extends Base implements Renderer {
  #secret = () => 1;
  private size = 3;
  static handleClick = async (e: Event): Promise<void> => { call(() => { function no() {} }); };
  constructor(private a: string) { super(); }
  @dec({ a: 1 }) open(x: { a: number } = { a: 1 }): void { if (x) { return; } }
  private audit() {}
  protected hook?(): string { return `class X { fn() {} }`; }
  get value(): number { return 1 }
  abstract draw(): void;
}
export interface Renderer { render(): string; readonly size: number }
type Size = { w: number; h: number };
declare const enum Color { Red, Green }
export default function main() {}
function* gen() {}
const helper = (a: number, b = 2): number => a + b;
let plain = { method() {} }, arrow = function () {};
describe("x", () => { function hidden() {} const no = () => 1; });
export namespace Outer { export class Store { get(): void {} } function inside() {} }
// class Comment {}
"""
    assert found("typescript", source) == [
        ("Widget", "class", None, "public"), ("secret", "method", "Widget", "private"), ("handleClick", "method", "Widget", "public"), ("constructor", "method", "Widget", "public"),
        ("open", "method", "Widget", "public"), ("audit", "method", "Widget", "private"), ("hook", "method", "Widget", "protected"), ("value", "method", "Widget", "public"),
        ("draw", "method", "Widget", "public"), ("Renderer", "trait", None, "public"), ("render", "method", "Renderer", "public"), ("Size", "struct", None, "private"),
        ("Color", "enum", None, "private"), ("main", "function", None, "public"), ("gen", "function", None, "private"), ("helper", "function", None, "private"),
        ("arrow", "function", None, "private"), ("Outer", "module", None, "public"), ("Store", "class", "Outer", "public"), ("get", "method", "Outer.Store", "public"),
        ("inside", "function", "Outer", "private"),
    ]


def test_javascript():
    source = """
class Account { deposit(n) { return /[}"]/.test(n) } static #hidden() {} }
export default { created() { this.x(() => {}) }, data: 1, async load() {} }
module.exports = { Account };
const Badge = ({ a }) => <div className="x">{a}</div>;
"""
    assert found("javascript", source) == [
        ("Account", "class", None, "private"), ("deposit", "method", "Account", "public"), ("hidden", "method", "Account", "private"),
        ("created", "method", None, "private"), ("load", "method", None, "private"), ("Badge", "function", None, "private"),
    ]
