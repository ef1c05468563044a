import datetime
import random
import re

from locuspark.llm import pii


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_card string")
    return sorted(pii.pseudonymize(df, key).collect(), key=lambda r: r["doc_id"])


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_formats_stay_valid_and_values_linked(spark):
    text = "card 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00 x ssn 123-45-6789 tel +1 (017) 555-7713 ip 97.51.17.173 on 2023-02-28, 28.02.2023 and 02/28/2023; geiß.34@mail7.example.com!"
    a, b = run(spark, [text, "again 123-45-6789 97.51.17.173 4111-1111-1111-1111"])
    new = a["text"]
    m = re.fullmatch(r"card ([\d ]{19}) iban DE(\d\d) ([\d ]{19}) (\d\d) x ssn (\d{3}-\d\d-\d{4}) tel \+1 \((\d{3})\) (\d{3}-\d{4}) ip ([\d.]+) on (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}) and (\d\d/\d\d/\d{4}); [g-pa-f]{16}@example.invalid!", new)
    assert m, new
    assert luhn(m[1].replace(" ", "")) and m[1] != "4111 1111 1111 1111"
    assert int((m[3] + m[4]).replace(" ", "") + "1314" + m[2]) % 97 == 1
    assert all(0 <= int(x) < 256 for x in m[8].split("."))
    day = datetime.date.fromisoformat(m[9])
    assert day.strftime("%d.%m.%Y") == m[10] and day.strftime("%m/%d/%Y") == m[11] and 1900 <= day.year < 2100
    assert b["text"] == f"again {m[5]} {m[8]} {m[1].replace(' ', '-')}"
    assert [a[f"n_{k}"] for k in pii.KINDS] == [1, 1, 3, 1, 1, 1, 1]
    assert run(spark, [text], "other")[0]["text"] != new


def test_what_is_not_valid_stays(spark):
    texts = ["DE88 3704 0044 0532 0130 00", "000-12-3456 666-12-3456 900-12-3456 123-00-4567", "2023-02-30", "1.2.3 and 300.1.1.1 and 1.2.3.4.5", "version 3.0 in 1999", "", None, "no numbers", "0123456789012"]
    assert [r["text"] for r in run(spark, texts)] == texts


def test_permutation_has_no_fixed_point_and_is_one_to_one(spark):
    from pyspark.sql import functions as F

    df = spark.range(7 * 5).select("id", pii.permuted("k", F.lit("t"), F.col("id"), F.lit(7).cast("long"), F.lit(5).cast("long")).alias("new"))
    got = {r["id"]: r["new"] for r in df.collect()}
    assert sorted(got.values()) == list(range(35)) and all(k != v for k, v in got.items())


def test_long_numbers_keep_length(spark):
    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(n)) for n in (1, 2, 5, 9, 12, 17, 18) for _ in range(5)]
    df = spark.createDataFrame([(s,) for s in numbers], "d string")
    got = [r[0] for r in df.select(pii.permuted_digits("k", "t", df["d"])).collect()]
    assert [len(g) for g in got] == [len(s) for s in numbers] and all(g.isdigit() for g in got)
    assert len({(len(s), g) for s, g in zip(numbers, got, strict=True)}) == len(set(numbers))


def test_empty_table(spark):
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_day_before_month_and_phone_linking(spark):
    texts = ["born 31/12/1980", "31/12/1980", "29/02/2000 30/02/2000 13/13/2000 12/31/1980", "+1 (017) 555-7713 +10175557713 +49 170 5557713", "card 4111 1111 1111 1112"]
    a, b, c, d, e = (r["text"] for r in run(spark, texts))
    assert a == "born " + b and re.fullmatch(r"(1[3-9]|2\d|3[01])/\d\d/(19|20)\d\d", b) and b != "31/12/1980"
    datetime.datetime.strptime(b, "%d/%m/%Y")
    first, second, third, fourth = c.split(" ")
    assert first != "29/02/2000" and second == "30/02/2000" and third == "13/13/2000"
    datetime.datetime.strptime(fourth, "%m/%d/%Y")
    one = re.match(r"(\+1 \(\d{3}\) \d{3}-\d{4}) (\+1\d{10}) \+49 ", d)
    assert re.sub(r"[^+\d]", "", one[1]) == one[2] != "+10175557713"
    assert e == texts[4]


def test_late_days_are_one_to_one(spark):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(1500)]
    shown = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    got = [r["text"] for r in run(spark, shown)]
    assert len(set(got)) == len(shown) and not any(x == y for x, y in zip(got, shown, strict=True))
    assert all(datetime.datetime.strptime(x, "%d/%m/%Y").day > 12 for x in got)


def permuted(key, label, x, a, b):
    """The permutation, with plain numbers and loops."""
    import hashlib

    def hashed(i, number, modulus):
        return int(hashlib.sha256(f"{key}|{label}|{i}|{number}".encode()).hexdigest()[:15], 16) % modulus

    def rounds(v, order, sign):
        l, r = divmod(v, b)
        for i in order:
            if i % 2 == 0:
                l = (l + sign * hashed(i, r, a)) % a
            else:
                r = (r + sign * hashed(i, l, b)) % b
        return l * b + r

    return rounds((rounds(x, range(pii.ROUNDS), 1) + 1) % (a * b), reversed(range(pii.ROUNDS)), -1)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(60):
        parts, new = [], []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
                then = datetime.date(1900, 1, 1) + datetime.timedelta(permuted("k", "date", (day - datetime.date(1900, 1, 1)).days, *pii.DAYS))
                parts.append(day.isoformat())
                new.append(then.isoformat())
            elif kind == 1:
                n = [rng.randrange(256) for _ in range(4)]
                v = permuted("k", "address", int.from_bytes(bytes(n)), 65536, 65536)
                parts.append(".".join(map(str, n)))
                new.append(".".join(map(str, v.to_bytes(4))))
            elif kind == 2:
                pay = "4" + "".join(rng.choice("0123456789") for _ in range(14))
                full = lambda p: p + next(c for c in "0123456789" if luhn(p + c))
                parts.append(full(pay))
                new.append(full(f"{permuted('k', 'card|15', int(pay), 10**8, 10**7):015d}"))
            else:
                parts.append(w := rng.choice(["word", "1234", "99.9", "é7"]))
                new.append(w)
        texts.append(" ; ".join(parts))
        want.append(" ; ".join(new))
    assert [r["text"] for r in run(spark, texts)] == want


def test_any_names_null_ids_repeats_long_texts(spark):
    long = "x y 123-45-6789 " * 20_000
    rows = [(None, "on 2023-02-28", 1, "a"), (None, "on 2023-02-28", 1, "a"), (5, long, 2, "b"), (6, None, 3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _made int, `made.x` string").withColumn("made", df_lit(7))
    out = pii.pseudonymize(df, "k")
    assert out.columns == [*df.columns, *(f"n_{k}" for k in pii.KINDS)]
    got = out.orderBy("_made").collect()
    assert got[0] == got[1] and got[0]["_made"] == 1 and got[0]["made"] == 7 and got[0]["text"] != "on 2023-02-28"
    assert got[2]["n_ssn"] == 20_000 and len(got[2]["text"]) == len(long) and "123-45-6789" not in got[2]["text"]
    assert got[3]["text"] is None and got[3]["n_ssn"] == 0


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
