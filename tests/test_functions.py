"""Column functions on values the generated tables cannot show."""

import random

from pyspark.sql import functions as F

from portolan.functions import dates, numbers, text


def values(spark, kind, rows, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression.alias("x")).collect()]


def test_parse_quantity(spark):
    dirty = ["1.234,56", "12.5", "-3", "abc", "", None, "1,2,3", "R$ 7,", ".", " 5 "]
    assert values(spark, "string", dirty, numbers.parse_quantity("v")) == [1234.56, 125.0, 3.0, 0, 0, 0, 12.3, 7.0, 0, 5.0]


def test_parse_quantity_is_one_pass(spark):
    """One pattern drops other characters and all decimal marks but the last, across line ends too."""
    assert str(numbers.parse_quantity("v")).count("regexp_replace") == 1
    assert values(spark, "string", ["1,2\n,5", "a,b", "1,,2", ",5,"], numbers.parse_quantity("v")) == [12.5, 0, 1.2, 5.0]


def test_parse_revenue(spark):
    assert values(spark, "string", ["R$ 1234,5", "1.234,56", None, "x"], numbers.parse_revenue("v")) == [1234.5, None, None, None]


def test_normalize_text(spark):
    names = ["AÇÃO", " São José\t", "ímpar", None, "№ ½x", "Ｆｕｌｌ"]
    assert values(spark, "string", names, text.normalize_text("v")) == ["acao", "sao jose", "impar", None, "no 12x", "full"]


def test_format_fixed_is_python_format(spark):
    rng = random.Random(3)
    xs = [25.575, 26.125, 28.575, 0.125, -0.125, 2.675, 1e-9, 123456789.005, 0.0, -7.5] + [rng.uniform(-1e4, 1e4) for _ in range(300)]
    for digits in (0, 1, 2):
        got = values(spark, "double", xs, numbers.format_fixed("v", digits))
        want = [f"{x:.{digits}f}" for x in xs]
        assert got == [w if float(w) else w.lstrip("-") for w in want]


def test_dates(spark):
    given = ["05/03/2024", "5/3/2024", "2024-03-05", "31/02/2024", "2024-03-05 10:00", "", None]
    got = values(spark, "string", given, dates.parse_date("v", "d/M/yyyy").cast("string"))
    assert got == ["2024-03-05", "2024-03-05", None, None, None, None, None]
    periods = ["202403", "2024-03", "03/2024", "03-2024", "2024/03", "202413", "x"]
    got = values(spark, "string", periods, dates.parse_period("v").cast("string"))
    assert got == ["2024-03-01"] * 5 + [None, None]


def test_share_links(spark):
    links = {
        "https://docs.google.com/spreadsheets/d/A-b_1/edit#gid=7": "https://docs.google.com/spreadsheets/d/A-b_1/export?format=csv&gid=7&usp=sharing",
        "https://docs.google.com/spreadsheets/d/A-b_1/edit": "https://docs.google.com/spreadsheets/d/A-b_1/export?format=csv&gid=0&usp=sharing",
        "https://dropbox.com/s/x?dl=0": "https://dropbox.com/s/x?dl=1",
        "https://dropbox.com/s/x": "https://dropbox.com/s/x?dl=1",
        "https://onedrive.live.com/view.aspx?resid=1": "https://onedrive.live.com/download.aspx?resid=1&download=1",
        "https://f.sharepoint.com/excel/a": "https://f.sharepoint.com/excel/a?download=1",
        "https://a.b/c.csv": "https://a.b/c.csv",
        "https://app.box.com/s/1": None,
    }
    assert values(spark, "string", list(links), text.direct_download_url("v")) == list(links.values())


def test_occurrences_do_not_overlap(spark):
    assert values(spark, "string", ["aaaa", "abab", ""], text.occurrences(F.col("v"), F.lit("aa"))) == [2, 0, 0]


def test_safe_name(spark):
    assert values(spark, "string", [" Plan: A/B ção (1).x "], text.safe_name("v")) == ["Plan_AB_ção_1.x"]


def test_normalizing_is_compatibility_folding(spark):
    """Against the standard library: the whole range by itself, and characters in the middle of texts."""
    import random
    import unicodedata

    def want(text):
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower().strip(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")

    rng = random.Random(6)
    given = ["ﬁm", "½", "①", "Ⅻ", "ﬀ", "São José ﬂuß", "㎏ ™ …", "𝐀𝟙", "Å̊", "한글 a", "", None, "a b", "\n½\n"]
    codes = [c for c in range(1, 0x2000) if not 0xD800 <= c < 0xE000] + list(range(0x2000, 0x3400)) + list(range(0xF900, 0x10000)) + list(range(0x1D400, 0x1D800)) + list(range(0x1F100, 0x1F200))
    given += ["x" + chr(c) + "y" for c in codes] + ["".join(chr(rng.choice(codes)) for _ in range(8)) for _ in range(500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r["i"]: r["n"] for r in frame.select("i", text.normalize_text("t").alias("n")).collect()}
    wrong = [(t, got[i], want(t)) for i, t in enumerate(given) if t is not None and got[i] != want(t)]
    assert not wrong and got[given.index(None)] is None


def test_long_forms_are_few_ranges_and_long_texts_are_read(spark):
    _, _, more, _ = text._folding()
    assert len(text._ranges(more)) < 200 < len(more)
    assert values(spark, "string", ["é½" + "a b" * 100_000 + "№ 한€"], text.normalize_text("v")) == ["e12" + "a b" * 100_000 + "no"]
