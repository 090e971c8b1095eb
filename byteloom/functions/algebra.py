"""The operator algebra over bytes: a catalogue, Column builders, the cheapest operator of a pair, programs and lookup tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAG_BITS, ID_BITS, LITERAL_BITS, LITERAL_TOKEN_BITS, RUN_TOKEN_BITS, BREAK_EVEN = 1, 5, 8, 9, 33, 4
#: An edge costs the identifier and the operand; it is worth a token below this cost.
WORTH_BELOW = 8


def _and(x, m=255):
    return x.bitwiseAND(F.lit(m)) if isinstance(x, Column) else x & m


def _rotate(x, n, right=False):
    n = 8 - n if right else n
    if isinstance(x, Column):
        return _and(F.shiftleft(x, n).bitwiseOR(F.shiftright(x, 8 - n)))
    return (x << n | x >> 8 - n) & 255


def _reversed_bits(x):
    for mask, s in ((0x55, 1), (0x33, 2), (0x0F, 4)):
        if isinstance(x, Column):
            x = F.shiftleft(_and(x, mask), s).bitwiseOR(_and(F.shiftright(x, s), mask))
        else:
            x = (x & mask) << s | x >> s & mask
    return x


@dataclass(frozen=True)
class Kind:
    """An operator type: apply works on Columns and on ints alike."""

    op_id: int
    name: str
    operand_bits: int
    operands: range
    apply: Callable
    text: str

    @property
    def cost(self) -> int:
        return ID_BITS + self.operand_bits


def _pick(f_col, f_int):
    return lambda x, k=0: f_col(x, k) if isinstance(x, Column) else f_int(x, k)


_ANY, _ONE_UP, _SHIFTS, _NO = range(256), range(1, 256), range(1, 8), range(0)
KINDS: dict[int, Kind] = {
    k.op_id: k
    for k in (
        Kind(0, "Add", 8, _ANY, lambda x, k=0: _and(x + k), "{v} + {k}"),
        Kind(1, "Sub", 8, _ANY, lambda x, k=0: _and(x - k), "{v} - {k}"),
        Kind(2, "Mul", 8, _ANY, lambda x, k=0: _and(x * k), "{v} * {k}"),
        Kind(3, "Div", 8, _ONE_UP, _pick(lambda x, k: F.floor(x / k).cast("int"), lambda x, k: x // k), "{v} / {k}"),
        Kind(4, "Mod", 8, _ONE_UP, lambda x, k=1: x % k, "{v} % {k}"),
        Kind(5, "Xor", 8, _ANY, _pick(lambda x, k: x.bitwiseXOR(F.lit(k)), lambda x, k: x ^ k), "{v} ^ {k}"),
        Kind(6, "And", 8, _ANY, lambda x, k=0: _and(x, k), "{v} & {k}"),
        Kind(7, "Or", 8, _ANY, _pick(lambda x, k: x.bitwiseOR(F.lit(k)), lambda x, k: x | k), "{v} | {k}"),
        Kind(8, "ShiftLeft", 3, _SHIFTS, _pick(lambda x, k: _and(F.shiftleft(x, k)), lambda x, k: x << k & 255), "{v} << {k}"),
        Kind(9, "ShiftRight", 3, _SHIFTS, _pick(lambda x, k: F.shiftright(x, k), lambda x, k: x >> k), "{v} >> {k}"),
        Kind(10, "Not", 0, _NO, lambda x, k=0: 255 - x, "~{v}"),
        Kind(11, "Inc", 0, _NO, lambda x, k=0: _and(x + 1), "{v}+1"),
        Kind(12, "Dec", 0, _NO, lambda x, k=0: _and(x + 255), "{v}-1"),
        Kind(13, "Identity", 0, _NO, lambda x, k=0: x, "{v}"),
        Kind(35, "RotateLeft", 3, _SHIFTS, lambda x, k=1: _rotate(x, k), "rotl({v}, {k})"),
        Kind(36, "RotateRight", 3, _SHIFTS, lambda x, k=1: _rotate(x, k, True), "rotr({v}, {k})"),
        Kind(37, "BitReverse", 0, _NO, lambda x, k=0: _reversed_bits(x), "bitrev({v})"),
        Kind(38, "NibbleSwap", 0, _NO, lambda x, k=0: _rotate(x, 4), "nibswap({v})"),
        Kind(39, "DeltaOfDelta", 0, _NO, lambda x, k=0: x, "Δ²({v})"),
    )
}
BASE = [KINDS[i] for i in range(14)]
BY_NAME = {k.name: k for k in KINDS.values()}


@dataclass(frozen=True)
class Op:
    """An operator with its operand, checked."""

    op_id: int
    operand: int = 0

    def __post_init__(self):
        kind = KINDS.get(self.op_id)
        if kind is None:
            raise ValueError(f"unknown operator {self.op_id}")
        if kind.operands and self.operand not in kind.operands:
            raise ValueError(f"{kind.name} takes no operand {self.operand}")

    @property
    def kind(self) -> Kind:
        return KINDS[self.op_id]

    @property
    def operand_bits(self) -> int:
        return self.kind.operand_bits

    def __call__(self, x):
        return self.kind.apply(x, self.operand)

    def text(self, v: str = "x") -> str:
        return self.kind.text.format(v=v, k=self.operand)


@dataclass(frozen=True)
class Formula:
    """a x^2 + b or a x + c, modulo 256."""

    a: int
    c: int
    square: bool = False
    operand_bits: int = 8

    def __call__(self, x):
        return _and((x * x if self.square else x) * self.a + self.c)

    def text(self, v: str = "x") -> str:
        return f"{self.a}*{v}{'^2' * self.square} + {self.c}"


@dataclass(frozen=True)
class Table:
    """A lookup of 256 values; also what iterated, fixed-point and conjugate operators become."""

    values: tuple[int, ...]
    label: str = "table[{v}]"
    operand_bits: int = 0

    def __post_init__(self):
        if len(self.values) != 256 or any(not 0 <= x <= 255 for x in self.values):
            raise ValueError("a table has 256 values of 0 to 255")

    def __call__(self, x):
        return F.get(F.array(*map(F.lit, self.values)), x.cast("int")) if isinstance(x, Column) else self.values[x]

    def text(self, v: str = "x") -> str:
        return self.label.format(v=v)


@dataclass(frozen=True)
class Composite:
    """Two to four operators, the first applied first."""

    steps: tuple

    def __post_init__(self):
        if not 2 <= len(self.steps) <= 4:
            raise ValueError("a composite has 2 to 4 steps")

    @property
    def operand_bits(self) -> int:
        return sum(ID_BITS + s.operand_bits for s in self.steps)

    def __call__(self, x):
        for s in self.steps:
            x = s(x)
        return x

    def text(self, v: str = "x") -> str:
        for s in self.steps:
            v = s.text(v)
        return v


def iterated(op, n: int) -> Table:
    def run(x):
        for _ in range(n):
            x = op(x)
        return x

    return Table(tuple(run(x) for x in range(256)), op.text("{v}") + f"^{n}")


def fixed_point(op, most: int) -> Table:
    def run(x):
        for _ in range(most):
            if (y := op(x)) == x:
                break
            x = y
        return x

    return Table(tuple(run(x) for x in range(256)), f"fixpoint({op.text('{v}')}, max={most})")


def conjugate(f, h) -> Table:
    """h^-1(f(h(x))); of several preimages the largest counts, values that h doesn't reach go to 0."""
    back = [0] * 256
    for x in range(256):
        back[h(x)] = x
    return Table(tuple(back[f(h(x))] for x in range(256)), "h⁻¹(" + f.text("h({v})") + ")")


_SUMS = {0: 1, 1: -1}


def fuse(first: Op, then: Op) -> Op | None:
    """One operator for two of a family, or None."""
    a, b = first.op_id, then.op_id
    if a in _SUMS and b in _SUMS:
        if a == b == 1:
            return Op(1, first.operand + then.operand & 255)
        return Op(0, _SUMS[a] * first.operand + _SUMS[b] * then.operand & 255)
    if a != b:
        return None
    if a == 10:
        return Op(0, 0)
    if a in (5, 6, 7):
        return Op(a, KINDS[a].apply(first.operand, then.operand))
    if a in (8, 9):
        n = first.operand + then.operand
        return Op(a, n) if n <= 7 else Op(6, 0)
    return None


def optimised(steps: Sequence):
    """Neighbours fused until none can be, additions of 0 dropped; one operator alone stands for itself."""
    chain, at = list(steps), 0
    while at < len(chain) - 1:
        one = fuse(chain[at], chain[at + 1]) if isinstance(chain[at], Op) and isinstance(chain[at + 1], Op) else None
        if one is None:
            at += 1
        else:
            chain[at : at + 2] = [one]
            at = 0
    kept = [s for s in chain if s != Op(0, 0)] or [Op(0, 0)]
    return kept[0] if len(kept) == 1 else Composite(tuple(kept))


# -- the cheapest operator that takes one byte to another


def _cases(a: Column, b: Column):
    yield 255 - a == b, 10, F.lit(0)
    yield _and(a + 1) == b, 11, F.lit(0)
    yield _and(a + 255) == b, 12, F.lit(0)
    yield a == b, 13, F.lit(0)
    for op in (8, 9):
        for k in range(1, 8):
            yield KINDS[op].apply(a, k) == b, op, F.lit(k)


def _struct(op: int, operand: Column, flag: int = 0) -> Column:
    return F.struct(F.lit(op).alias("op_id"), operand.cast("int").alias("operand"), F.lit(KINDS[op].cost + flag).alias("cost"))


def cheapest(a: Column, b: Column) -> Column:
    """struct<op_id, operand, cost> by closed form: cost-free operands first, then shifts, then an addition."""
    out = None
    for test, op, operand in _cases(a, b):
        out = F.when(test, _struct(op, operand)) if out is None else out.when(test, _struct(op, operand))
    return out.otherwise(_struct(0, _and(b - a)))


def cheapest_extended(a: Column, b: Column) -> Column:
    """The same with bit reversal, nibble swap and rotations, compared by token cost; base operators win ties of their cost."""
    out = None
    extra = [(KINDS[37].apply(a) == b, 37, F.lit(0)), (KINDS[38].apply(a) == b, 38, F.lit(0))]
    base = list(_cases(a, b))
    rotations = [(KINDS[35].apply(a, k) == b, 35, F.lit(k)) for k in range(1, 8)]
    for test, op, operand in [*base[:4], *extra, *base[4:], *rotations]:
        out = F.when(test, _struct(op, operand)) if out is None else out.when(test, _struct(op, operand))
    return out.otherwise(_struct(0, _and(b - a)))


@lru_cache(maxsize=1)
def library() -> list[Op]:
    """All base operators in registration order: by type, operands ascending, those without operands last."""
    return [Op(k.op_id, n) for k in BASE for n in (k.operands or [0])]


def lookup(spark: SparkSession, extended: bool = False) -> DataFrame:
    """The 65,536 rows (a, b, op_id, operand, cost)."""
    pairs = spark.range(65536).select(F.shiftright("id", 8).cast("int").alias("a"), F.col("id").bitwiseAND(255).cast("int").alias("b"))
    best = (cheapest_extended if extended else cheapest)(F.col("a"), F.col("b"))
    return pairs.withColumn("o", best).select("a", "b", "o.*")


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k.op_id, k.name, k.operand_bits, min(k.operands, default=0), max(k.operands, default=0)) for k in KINDS.values()]
    return spark.createDataFrame(rows, "op_id int, name string, operand_bits int, min_operand int, max_operand int")


def expression(op_id: Column, operand: Column, v: str = "x") -> Column:
    out = None
    for k in KINDS.values():
        text = F.format_string(k.text.format(v=v, k="%d").replace("x % %d", "x %% %d"), operand) if k.operands else F.lit(k.text.format(v=v))
        out = F.when(op_id == k.op_id, text) if out is None else out.when(op_id == k.op_id, text)
    return out


def applied(op_id: Column, operand: Column, x: Column) -> Column:
    """The value of an operator given by columns."""
    x, k = x.cast("int"), operand.cast("int")
    shifted = lambda f: F.expr("0") if f is None else f
    forms = {0: _and(x + k), 1: _and(x - k), 2: _and(x * k), 3: F.when(k != 0, F.floor(x / k).cast("int")), 4: F.when(k != 0, x % k), 5: x.bitwiseXOR(k), 6: x.bitwiseAND(k), 7: x.bitwiseOR(k), 8: _and((x * F.pow(F.lit(2), k)).cast("int")), 9: F.floor(x / F.pow(F.lit(2), k)).cast("int"), 10: 255 - x, 11: _and(x + 1), 12: _and(x + 255), 13: x}
    out = None
    for i, f in forms.items():
        out = F.when(op_id == i, shifted(f)) if out is None else out.when(op_id == i, f)
    return out


def token_cost(op) -> int:
    return FLAG_BITS + ID_BITS + op.operand_bits


def better_than_literal(op) -> bool:
    return token_cost(op) < LITERAL_BITS


def better_than_literal_token(op) -> bool:
    return token_cost(op) < LITERAL_TOKEN_BITS


def run_saving(length):
    """Bits that a run token saves over literals; of an int or a Column."""
    return length * LITERAL_TOKEN_BITS - RUN_TOKEN_BITS


def clusters(count: int) -> list[tuple[int, int]]:
    """(centroid, radius) of value clusters: every byte by itself, whatever number of 1 to 256 is asked for."""
    if not 1 <= count <= 256:
        raise ValueError("1 to 256 clusters")
    return [(v, 0) for v in range(256)]


def clustered(v: Column, centroid: Column, radius: Column) -> Column:
    """Whether a value lies within a cluster's radius."""
    return F.abs(v - centroid) <= radius


def arity(op) -> str:
    """UNARY, or BINARY for operators that can take the value before as well."""
    return "BINARY" if getattr(op, "op_id", None) == BY_NAME["DeltaOfDelta"].op_id else "UNARY"


def second_delta(before: Column, value: Column, after: Column) -> Column:
    """The change of steps over three values, modulo 256."""
    return ((after - value) - (value - before)).bitwiseAND(255)
