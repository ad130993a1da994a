"""Expressions over mnemonics and operands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in the order of the test; first the prefixes, then the parts of a mnemonic.
CATEGORIES = (
    ("Arithmetic", ("add", "sub", "mul", "div", "inc", "dec"), ()),
    ("Logic", ("and", "or", "xor", "not", "shl", "shr"), ()),
    ("Memory", ("mov", "lea", "push", "pop", "load", "store"), ()),
    ("Control", ("jmp", "je", "jne", "jz", "jnz", "call", "ret", "br", "bl"), ()),
    ("System", ("int", "syscall", "sysenter", "sysexit"), ()),
    ("Crypto", (), ("aes", "sha", "crypto")),
    ("Float", ("fadd", "fsub", "fmul", "fdiv"), ()),
    ("Vector", ("v",), ("xmm", "ymm", "zmm")),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category(mnemonic: Column | str) -> Column:
    """One of nine categories, the first that fits the lower-cased mnemonic."""
    low, out = F.lower(_col(mnemonic)), F.lit("Unknown")
    for name, prefixes, parts in reversed(CATEGORIES):
        tests = [f"^(?:{'|'.join(prefixes)})"] * bool(prefixes) + ["|".join(parts)] * bool(parts)
        out = F.when(low.rlike("|".join(tests)), F.lit(name)).otherwise(out)
    return out


#: The greatest number of 64 bits, as text of 20 digits.
_MOST = "18446744073709551615"


def operand_address(operands: Column | str) -> Column:
    """The address of operands that are nothing but one, in 0x digits or decimal; else null. From 2^63 on it is negative."""
    text = _col(operands)
    digits = F.regexp_extract(text, "^0x0*([0-9a-fA-F]{1,16})$", 1)
    plain = F.regexp_extract(text, "^\\+?([0-9]{1,20})$", 1)
    # conv to base -10 gives the signed number with the same bits.
    return F.when(digits != "", F.conv(digits, 16, -10).cast("long")).when((plain != "") & (F.lpad(plain, 20, "0") <= _MOST), F.conv(plain, 10, -10).cast("long"))


def flow(mnemonic: Column | str, operands: Column | str) -> Column:
    """Struct (kind, target): Sequential, Jump, ConditionalJump, Call, Return, Interrupt or Unknown (no plain target)."""
    m, target = F.lower(_col(mnemonic)), operand_address(operands)
    with_target = lambda kind: F.when(target.isNotNull(), F.lit(kind)).otherwise(F.lit("Unknown"))
    kind = (
        F.when(m.isin("ret", "retn"), "Return")
        .when(m == "call", with_target("Call"))
        .when(m.startswith("jmp"), with_target("Jump"))
        .when(m.startswith("j") & (F.length(m) > 1), with_target("ConditionalJump"))
        .when(m.isin("int", "syscall"), "Interrupt")
        .otherwise("Sequential")
    )
    return F.struct(kind.alias("kind"), F.when(kind.isin("Jump", "ConditionalJump", "Call"), target).alias("target"))


def with_flow(instructions: DataFrame) -> DataFrame:
    """instructions with flow_kind and flow_target from mnemonic and operands.

    The struct goes through a generator, so that it is computed once: as columns of a projection it
    would be copied into every later expression that uses it.
    """
    kept = [c for c in instructions.columns if c not in ("flow_kind", "flow_target")]
    return instructions.select(*kept, F.inline(F.array(flow("mnemonic", "operands"))).alias("flow_kind", "flow_target"))


def split_text(text: Column | str) -> Column:
    """Struct (mnemonic, operands) of a formatted instruction, split at the first blank."""
    t = F.trim(_col(text))
    parts = F.split(t, " ", 2)
    return F.struct(F.element_at(parts, 1).alias("mnemonic"), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, 2))).otherwise(F.lit("")).alias("operands"))


def complexity_level(cyclomatic: Column | str) -> Column:
    c = _col(cyclomatic)
    return F.when((c >= 1) & (c <= 10), "Low").when((c >= 11) & (c <= 20), "Moderate").when((c >= 21) & (c <= 50), "High").otherwise("Very High")
