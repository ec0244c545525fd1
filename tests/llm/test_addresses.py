import pytest

from millrace.llm import addresses


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("845 S Haponir Boulevard, Suite 4, Hevaunogust, CO 12345-6789", ("845", "s", "haponir", "boulevard", "hevaunogust", "co", "12345")),
        ("st. gehaugom\nco 35608\n3240 church pky", ("3240", "", "church", "parkway", "saint gehaugom", "co", "35608")),
        ("N. Carolina 43756, 1555 NAUZUKAR PKWY WEST", ("1555", "w", "nauzukar", "parkway", "", "nc", "43756")),
        ("lO84 Kedaunom Ln; Lesaukaufim; IL", ("1084", "", "kedaunom", "lane", "lesaukaufim", "il", "")),
        ("Depautom-Platz 282 Geb. 4, D-77997 Tikamidaund, Deutschland", ("282", "", "depautom", "platz", "tikamidaund", "", "77997")),
        ("Sakaufaubromstraße 1131 / 42, Fanagaum", ("1131", "", "sakaufaubrom", "strasse", "fanagaum", "", "")),
        ("#108 Tingkat 40 Lor. Lake 82847", ("108", "", "lake", "lorong", "", "", "82847")),
        ("Jln. Harbor, No 1645, Saint Zurak", ("1645", "", "harbor", "jalan", "saint zurak", "", "")),
        ("10245 Main St, Dallas, TX 75201", ("10245", "", "main", "street", "dallas", "tx", "75201")),
        ("12 5th Ave, Trenton, NJ 10003", ("12", "", "5th", "avenue", "trenton", "nj", "10003")),
        ("12 Martin Luther King Blvd, Dallas, TX 75201", ("12", "", "martin luther king", "boulevard", "dallas", "tx", "75201")),
        ("10245 N Main St, Dallas, TX", ("10245", "n", "main", "street", "dallas", "tx", "")),
        ("Bauhaumaus 16984", None),
        ("Dazevisick Heights", None),
        ("87018", None),
        ("N/A", None),
        ("", None),
        (None, None),
    ],
)
def test_reading(text, want):
    got = addresses.read_address(text)
    assert (tuple(got.values()) if got else None) == want


ROWS = [
    ("a1", "845 South Haponir Boulevard, Suite 4, Hevaunogust, CO 12345"),
    ("a1", "845 South Haponir Boulevard, Suite 4, Hevaunogust, CO 12345"),
    ("a2", "CO 12345 - HEVAUNOGUST - 845 S HAPONIIR BLVD"),
    ("a3", "845 S. Haponir Blvd, Hevaunogust, Colorado"),
    ("a4", "847 South Haponir Boulevard, Hevaunogust, CO 12345"),
    ("a5", "845 N Haponir Boulevard, Hevaunogust, CO 12345"),
    ("a6", "845 S Haponir Blvd, CO"),
    ("b1", "Parkweg 274, 74505 Sunadidond"),
    ("b2", "Patk-Weg 274,Sunadidond"),
    ("b3", "Parkweg 274, 70000 Libraubick"),
    ("c1", "Lot 1887, Psrn. Mill, 86339 Vulausazond"),
    ("c1", None),
    ("c2", "no 1887 persiaran mill, level 3, vulausazond"),
    ("d1", ""),
    ("d2", "Hevaunogust, CO"),
    ("d3", "12345"),
    (None, "845 South Haponir Boulevard, Suite 4, Hevaunogust, CO 12345"),
    ("e1", "x " * 20_000),
]


def run(spark, rows, vendor="Corner Bakery"):
    df = spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else vendor, 1) for r in rows], "receipt_id string, vendor_address string, vendor_name string, location int")
    return sorted(tuple(r) for r in addresses.same_place(df).collect())


def test_same_place(spark):
    want = [("a1", "a2"), ("a1", "a3"), ("a1", "a6"), ("a2", "a3"), ("a2", "a6"), ("a3", "a6"), ("b1", "b2"), ("c1", "c2")]
    assert run(spark, ROWS) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", None), ("b", "")]) == []


def test_a_town_of_many_postcodes_keeps_them_all(spark):
    rows = [(f"z{k:02}", f"{100 + k} Larkspur Ave, Dallas, TX {75200 + k}") for k in range(12)]
    assert run(spark, [*rows, ("a", "111 Larkspur Avenue, Dallas, TX"), ("b", "100 larkspur av dallas tx")]) == [("a", "z11"), ("b", "z00")]
    for beam in (1, 50):
        df = spark.createDataFrame([*rows, ("a", "111 Larkspur Avenue, Dallas, TX")], "receipt_id string, vendor_address string").selectExpr("*", "'x' as vendor_name")
        assert [tuple(r) for r in addresses.same_place(df, beam).collect()] == [("a", "z11")]


def test_streets_alike_at_one_number_stay_apart(spark):
    rows = [("a", "12 Hill St, Dayton, OH 45402"), ("b", "12 Mill St, Dayton, OH 45402"), ("c", "12 Hill Street, Dayton OH 45402"), ("d", "14 Mill St, Dayton, OH 45402")]
    assert run(spark, rows) == [("a", "c")]


def test_a_missing_direction_joins_no_two_places(spark):
    rows = [("n1", "845 N Oak St, Dayton, OH 45402"), ("n2", "845 North Oak Street, Dayton, OH 45402"), ("s", "845 S Oak St, Dayton, OH 45402"), ("x", "845 Oak St, Dayton, OH 45402")]
    assert run(spark, rows) == [("n1", "n2"), ("n1", "x"), ("n2", "x")]


def test_a_misread_postcode(spark):
    rows = [("a", "300 Larkspur Ave, Dallas, TX 75211"), ("b", "300 Larkspur Avenue, Dallas TX 75211"), ("c", "300 Larkspur Ave, Dallas, TX 75217"), ("d", "302 Larkspur Ave, Austin, TX 75217")]
    assert run(spark, rows) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_a_vendor_vouches_for_a_misspelt_street(spark):
    rows = [("a", "12 Mill St, Dayton, OH 45402", "Corner Bakery"), ("b", "12 Mill Street, Dayton OH 45402", "Corner Bakery Ltd"), ("c", "12 Milk St, Dayton, OH 45402", "corner bakery"), ("d", "12 Mall St, Dayton, OH 45402", "Shoe Repairs")]
    assert run(spark, rows) == [("a", "b"), ("a", "c"), ("b", "c")]
