import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from codestrata.functions.symbols import hex_u64
from codestrata.operators import symbols as s
from codestrata.plans.jobs import compare_libraries
from codestrata.sources import readers

HEAD = """
File: out/dsp.bin
  Machine:   RISC-V \t
   9: 00ff 1 FUNC GLOBAL DEFAULT 1 not_in_a_table
"""
TABLE = """
Symbol table '{name}' contains {n} entries:
   Num:    Value          Size Type    Bind   Vis      Ndx Name
"""


def entry(num, address, size, kind, bind, section, name):
    return f"  {num:4d}: {address:016x} {size:5d} {kind:7s} {bind:6s} DEFAULT {section:>4s} {name}"


FILTERS = "\n".join(
    [
        entry(0, 0, 0, "NOTYPE", "LOCAL", "UND", ""),
        entry(1, 0x8A40, 412, "FUNC", "GLOBAL", "11", "fir_apply"),
        entry(2, 0x8BDC, 96, "FUNC", "LOCAL", "11", "fir_reset"),
        entry(3, 0xF00D0, 2**64 - 1, "OBJECT", "GLOBAL", "24", "taps"),
        entry(4, 0, 0, "NOTYPE", "GLOBAL", "UND", "sqrtf"),
        entry(5, 0x40, 8, "COMMON", "GLOBAL", "COM", "scratch"),
        entry(6, 0, 0, "FILE", "LOCAL", "ABS", "fir.c"),
    ]
)
LISTING = HEAD + TABLE.format(name=".symtab", n=7) + FILTERS + "\n"


def dumps(spark, *bodies):
    return spark.createDataFrame([(f"/l/lib{i}.so", b) for i, b in enumerate(bodies)], "path string, body string")


def test_listing(spark, rows):
    got = s.parse_symbols(dumps(spark, LISTING)).orderBy("ord").collect()
    assert [(r.name, r.type, int(r.size), r.is_global) for r in got] == [
        ("fir_apply", "Function", 412, True), ("fir_reset", "Function", 96, False), ("taps", "Variable", 2**64 - 1, True),
        ("sqrtf", "Undefined", 0, True), ("scratch", "Common", 8, True), ("fir.c", "Other", 0, False),
    ]
    assert got[2].address == Decimal(0xF00D0)
    assert rows(s.libraries(dumps(spark, LISTING, "no header"))) == [
        ("/l/lib0.so", "RISC-V", True), ("/l/lib1.so", "unknown", True),
    ]


def test_second_table_and_odd_rows(spark, rows):
    more = [
        entry(1, 2**64 - 1, 8, "FUNC", "WEAK", "2", "weak name with blanks"),
        entry(2, 0, 0, "FUNC", "GLOBAL", "UND", "needed_elsewhere"),
        entry(3, 0, 0, "FUNC", "GLOBAL", "2", "bad_address").replace(f"{0:016x}", "nothex".rjust(16)),
        entry(4, 1, 2**64, "OBJECT", "GLOBAL", "2", "beyond_64_bits"),
        entry(5, 1, 1, "OBJECT", "GLOBAL", "2", "x" * 3000),
    ]
    parsed = s.parse_symbols(dumps(spark, LISTING + TABLE.format(name=".dynsym", n=5) + "\n".join(more)))
    assert parsed.count() == 9
    top = parsed.where(F.col("name") == "weak name with blanks").first()
    assert (top.address, top.is_global, top.type) == (Decimal(2**64 - 1), False, "Function")
    names = {r.name for r in s.exported(parsed).collect()}
    assert names == {"fir_apply", "taps", "scratch", "needed_elsewhere", "x" * 3000}
    assert [r.name for r in s.imported(parsed).collect()] == ["sqrtf"]


def test_hex(spark):
    df = spark.createDataFrame([("zz",), ("10",), ("",)], "h string")
    assert [r[0] for r in df.select(hex_u64(F.col("h"))).collect()] == [None, Decimal(16), None]


def listing(*rows):
    return TABLE.format(name=".symtab", n=len(rows)) + "\n".join(entry(k, *r) for k, r in enumerate(rows))


def test_compare_libraries(spark, rows):
    """The same name in two libraries, moved, resized, dropped, doubled."""
    audio = [(0x10, 20, "FUNC", "GLOBAL", "1", "open"), (0x30, 7, "FUNC", "GLOBAL", "1", "mute"), (0x50, 4, "OBJECT", "LOCAL", "2", "twice"), (0x60, 4, "OBJECT", "LOCAL", "2", "twice")]
    video = [(0x90, 33, "FUNC", "GLOBAL", "1", "open"), (0xB0, 5, "OBJECT", "GLOBAL", "2", "gamma")]
    audio_now = [(0x10, 20, "FUNC", "GLOBAL", "1", "open"), (0x60, 4, "OBJECT", "LOCAL", "2", "twice"), (0x70, 9, "FUNC", "GLOBAL", "1", "fade")]
    video_now = [(0x90, 34, "FUNC", "GLOBAL", "1", "open"), (0xB0, 5, "OBJECT", "GLOBAL", "2", "gamma")]
    old = dumps(spark, listing(*audio), listing(*video))
    new = dumps(spark, listing(*audio_now), listing(*video_now)).withColumn("path", F.replace("path", F.lit("/l/"), F.lit("/new/")))
    got = rows(compare_libraries(old, new).select("library", "name", "change", F.col("size").cast("int")))
    assert got == [
        ("lib0.so", "fade", "added", 9), ("lib0.so", "mute", "removed", 7), ("lib0.so", "open", "common", 20), ("lib0.so", "twice", "common", 4),
        ("lib1.so", "gamma", "common", 5), ("lib1.so", "open", "modified", 34),
    ]
    assert {r.change for r in compare_libraries(old, old).where("name <> 'twice'").collect()} == {"common"}


def test_reading_listings(spark, tmp_path):
    (tmp_path / "liba.so.txt").write_text(LISTING)
    (tmp_path / "libb.so.txt").write_text("\n")
    good, empty = readers.read_symbol_dumps(spark, str(tmp_path))
    assert good.count() == 1 and empty.first().error == "io_error"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_symbol_dumps(spark, str(tmp_path / "missing"))
