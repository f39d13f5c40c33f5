import datetime
import hashlib

from pyspark.sql import functions as F

from gridledger.llm import pii
from tests.llm import cases

KEY = "test key"


def keyed(tweak, step, value, size):
    digest = hashlib.sha256(f"{KEY}|{tweak}|{step}|{value}".encode()).hexdigest()
    return int(digest[:15], 16) % size


def feistel(tweak, a, b, m, n):
    for step in range(1, pii.ROUNDS + 1):
        a, b, m, n = b, (a + keyed(tweak, step, b, m)) % m, n, m
    return a, b


def digits(tweak, text):
    cut = len(text) // 2
    a, b = feistel(f"{tweak}{len(text)}", int(text[:cut] or 0), int(text[cut:]), 10**cut, 10 ** (len(text) - cut))
    return (str(a).zfill(cut) if cut else "") + str(b).zfill(len(text) - cut)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def masked(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.mask(frame, KEY).orderBy("doc_id").collect()]


def test_numbers_against_plain_python(spark):
    cards = ["4111111111111111", "5500005555555559", "378282246310005", "4222222222222"]
    for card, got in zip(cards, masked(spark, [f"pay {c} now" for c in cards])):
        payload = digits("card", card[:-1])
        check = next(d for d in "0123456789" if luhn(payload + d) == 0)
        assert got == f"pay {payload}{check} now"
    a, b = feistel("ipv4", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    assert masked(spark, ["97.51.17.173"]) == [f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"]
    day = (datetime.date(2020, 2, 29) - datetime.date(1901, 1, 1)).days
    a, b = feistel("day", day // 673, day % 673, 108, 673)
    fresh = datetime.date(1901, 1, 1) + datetime.timedelta(a * 673 + b)
    assert masked(spark, ["2020-02-29", "29.02.2020", "29/02/2020", "02/29/2020"]) == [
        fresh.isoformat(), fresh.strftime("%d.%m.%Y"), fresh.strftime("%d/%m/%Y"), fresh.strftime("%m/%d/%Y"),
    ]
    phone = digits("phone", "0175557713")
    assert masked(spark, ["+1 (017) 555-7713"]) == [f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}"]


def test_formats_stay_and_values_stay_linked(spark):
    card, spaced = masked(spark, ["x 4111111111111111 y 4111111111111111", "4111 1111 1111 1111"])
    first, second = card.split()[1::2]
    assert first == second == spaced.replace(" ", "") and luhn(first) == 0 and first != "4111111111111111"
    (mail,) = masked(spark, ["write Und.34@mail7.example.com, please"])
    name = mail.split()[1].split("@")[0]
    assert mail.endswith("@mail7.example.com, please") and name[3] == "." and name[4:].isdigit() and name[:3].isalpha()
    assert masked(spark, ["UND.34@mail7.example.com"])[0].split("@")[0] == name


def test_invalid_values_stay(spark):
    texts = [
        "9807915762804490", "4111111111111112", "31.02.2020", "1850-01-01", "2100-01-01", "666-11-1111",
        "000-11-1111", "300.1.1.1", "1.2.3.4.5", "abc4111111111111111", "v1.2.3", "12-34", "no numbers",
    ]
    assert masked(spark, texts) == texts


def test_each_format_is_permuted(spark):
    """No two values of a format share a pseudonym."""
    codes = spark.range(1000).select(pii._permute_digits(KEY, "t", F.lpad(F.col("id").cast("string"), 3, "0")))
    assert codes.distinct().count() == 1000
    days = spark.range(pii.DAYS).select(
        pii._day(KEY, F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int"))).alias("d")
    )
    assert days.distinct().count() == pii.DAYS
    names = spark.range(676).select(
        pii._permute_letters(KEY, "t", F.concat(F.char(97 + F.col("id") % 26), F.char(97 + F.floor(F.col("id") / 26))))
    )
    assert names.distinct().count() == 676


def test_awkward_rows(spark):
    frame = cases.awkward(spark, "_pieces").unionByName(
        spark.createDataFrame([(30, "id 123-45-6789 " * 3000, "en", "a", 1)], cases.SCHEMA).withColumn("_pieces", F.lit("x"))
    )
    out = pii.mask(frame, KEY, count="n")
    assert out.columns == [*frame.columns, "n"]
    assert out.filter("doc_id = 30").first()["n"] == 3000
    rest = out.filter("doc_id <> 30 OR doc_id IS NULL")
    assert rest.agg(F.sum("n")).first()[0] == 0
    assert sorted(map(repr, rest.select("text").collect())) == sorted(
        map(repr, frame.filter("doc_id <> 30 OR doc_id IS NULL").select("text").collect())
    )
    assert pii.mask(cases.empty(spark), KEY).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
