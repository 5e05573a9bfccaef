from pyspark.sql import functions as F

from rollcall.functions import normalize as N
from rollcall.functions import validate as V


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def luhn(nine):
    """The check digit by hand: the prefix's digits count 24."""
    total = 24
    for i, d in enumerate(map(int, nine)):
        total += d if i % 2 else d * 2 // 10 + d * 2 % 10
    return (10 - total % 10) % 10


def test_identifiers(spark):
    nine = [f"{1 + i % 2}{(i * 7654321) % 10**8:08d}" for i in range(40)]
    good = [x + str(luhn(x)) for x in nine]
    assert column(spark, nine, V.luhn_digit) == [luhn(x) for x in nine]
    assert column(spark, good, V.valid_npi) == [True] * 40
    assert column(spark, [x[:9] + str((int(x[9]) + k) % 10) for x in good for k in range(1, 10)], V.valid_npi) == [False] * 360
    odd = [None, "", " " + good[0] + "\t", good[1][:8], good[1] + "0", "7" + good[1][1:], good[1][:4] + " " + good[1][5:], "x" * 10]
    assert column(spark, odd, V.valid_npi) == [False, False, True] + [False] * 5
    assert column(spark, [int(good[2])], V.valid_npi, "long") == [True]


def test_names(spark):
    given = {None: "", "\t \n": "", "MIREILLE  k. d'ARTAGNAN": "Mireille K D'Artagnan", "prof. tomas vondra": "Tomas Vondra", "Okafor-Lund, Ines": "Ines Okafor-Lund",
             "Bianca Moretti, rn": "Bianca Moretti", "Yusuf, MD, PhD": "Yusuf, Md,", "...": "", "Ms": "", "jean-luc o'shea": "Jean-Luc O'Shea"}
    assert column(spark, list(given), N.name_display) == list(given.values())
    assert column(spark, ["jean-luc o'SHEA", "Okafor-Lund, Ines"], N.name_compare) == ["jeanluc oshea", "ines okaforlund"]


def test_phones_states_zips(spark):
    phones = {"3035550142": "(303) 555-0142", "303.555.0142": "(303) 555-0142", "+1 303 555 0142": "(303) 555-0142", "13035550142": "(303) 555-0142",
              "1303555014": "(130) 355-5014", "23035550142": "", "5550142": "", "303 555 0142 x7": "", None: ""}
    assert column(spark, list(phones), N.phone_display) == list(phones.values())
    states = {"vermont": "VT", " District of Columbia ": "DC", "wy": "WY", "Puerto Rico": "PUERTO RICO", None: "", "  ": ""}
    assert column(spark, list(states), N.state_code) == list(states.values())
    assert column(spark, ["80202-4417", "802", "8 0 2 0 2 9", None], N.zip5) == ["80202", "802", "80202", ""]


def test_addresses(spark):
    streets = {  # street: (display, unit)
        "1420 S Larimer Blvd., Ste. 12B": ("1420 South Larimer Boulevard", "12B"), "77 Quarry ln #9": ("77 Quarry Lane", "9"), "77 Quarry ln # 9": ("77 Quarry Lane", "9"),
        "5 NW Harbor ter Floor 2": ("5 Northwest Harbor Terrace", "2"), "31 Mill Ct, Rear Entrance, Apt C": ("31 Mill Court", "C"), "31 Mill Ct, Unit 4, Room 6": ("31 Mill Court", "6"),
        "8 Cedar Sq, Suite": ("8 Cedar Square", "Suite"), "42ND Hwy": ("42nd Highway", ""), "12 Orchard Rd Apt": ("12 Orchard Road", ""), "Unit 3": ("", "3"), None: ("", ""), " , ": ("", "")}
    got = column(spark, list(streets), lambda c: F.struct(N.street_display(c), N.unit(c)))
    assert [tuple(x) for x in got] == list(streets.values())
    df = spark.createDataFrame([("1420 s larimer BLVD", "Fort  Collins", "colorado", "80202-1", )], "a string, b string, c string, d string")
    assert df.select(N.location_key(*[F.col(x) for x in "abcd"])).first()[0] == "1420 south larimer boulevard||fort collins|co|80202"


def test_zero_is_a_value(spark):
    assert column(spark, ["0", None, " "], lambda c: N.compare_form("is_active", c)) == ["0", "", ""]


def test_normalizers_are_pasted_once(spark):
    """What later steps do with a derived key must not multiply the work that makes it."""
    df = spark.createDataFrame([("1 A St", "b", "c", "d")], "a string, b string, c string, d string")
    keyed = N.derive(df, {"key": N.location_key(*[F.col(x) for x in "abcd"])}).filter("replace(key, '|', '') <> ''")
    plan = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 0 and key <> 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") < 20
