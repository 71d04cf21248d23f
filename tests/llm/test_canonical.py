import pytest

from helixmill.llm import canonical as c

CODES = "field_name string, entry string, aliases array<string>"
CODE_ROWS = [("gender", "male", ["M", "man"]), ("gender", "female", ["F", "woman", "féminin"]), ("tumor_stage", "Stage I", ["I"]), ("tumor_stage", "Stage II", ["II"]), ("tumor_stage", "Stage IIA", ["IIA"]), ("vital_status", "alive", []), ("vital_status", "lost to follow-up", None)]
FIELDS = ["gender", "tumor_stage", "vital_status"]


def mapped(spark, column, values, codes=CODE_ROWS):
    rows = spark.createDataFrame([(i, *[v if f == column else None for f in FIELDS], "x", "y") for i, v in enumerate(values)], "row_id long, gender string, tumor_stage string, vital_status string, entry string, how string")
    out = c.map_rows(rows, "row_id", FIELDS, spark.createDataFrame(codes, CODES)).collect()
    return {r["row_id"]: (r["entry"], r["how"]) for r in out}


@pytest.mark.parametrize(
    ("column", "pairs"),
    [
        ("gender", {"male": "male", " Male ": "male", "mlae": "male", "Féminin": "female", "femnin": "female", '"female"': "female", "sex: F": "female", "female (per chart)": "female", "male - confirmed": "male", "Frau": "female", "xx": "unmatched", "37.5": "unmatched", "alive": "unmatched", "???": "unmatched", "unknown": "unmatched", "femalexxxx" * 3000: "unmatched"}),
        ("tumor_stage", {"Stage II": "Stage II", "satge ii": "Stage II", "stage_2": "Stage II", "Ⅱ": "Stage II", "lI": "Stage II", "pstage two a": "Stage IIA", "II-A (AJCC)": "Stage IIA", "st. 1": "Stage I", "stage ii confirmed": "Stage II", "grade 2": "unmatched", "16/11/2022": "unmatched", "stage ix": "unmatched", "female": "unmatched"}),
        ("vital_status", {"alive": "alive", "alvie": "alive", "am Leben": "alive", "Lost tof ollow-up": "lost to follow-up", "male": "unmatched", "--": "unmatched"}),
    ],
)
def test_values(spark, column, pairs):
    got = mapped(spark, column, list(pairs))
    assert {v: got[i][0] for i, v in enumerate(pairs)} == pairs


def test_null_blank_and_repeats(spark):
    got = mapped(spark, "gender", [None, "", " \t", " ", "mael", "mael", "male"])
    assert set(got) == {4, 5, 6} and got[6][1] == "verbatim" and got[4] == got[5] == ("male", "close")


def test_empty_lists_and_tables(spark):
    assert mapped(spark, "gender", ["male"], codes=[]) == {0: ("unmatched", "none")}
    assert mapped(spark, "gender", []) == {}


def test_pigeonhole_finds_all_close_strings(spark):
    """Against comparing every value with every reference string."""
    import random

    rng = random.Random(5)
    names = ["munich", "barcelona", "copenhagen", "thessaloniki", "san sebastian norte"]

    def typo(s):
        for _ in range(rng.randint(0, 4)):
            i, a = rng.randrange(len(s)), rng.choice("abcxyz")
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + a + s[i:], s[:i] + a + s[i + 1 :]]) or "a"
        return s

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    values = sorted({typo(rng.choice(names)) for _ in range(150)})
    values = [v for v in values if v == " ".join(v.split())]
    got = mapped(spark, "gender", values, codes=[("gender", n, None) for n in names])
    limit = lambda n: 0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 16 else 4
    for i, v in enumerate(values):
        near = [n for n in names if distance(v, n) <= limit(len(n))]
        if near:
            assert got[i][0] in near, v
        elif not any(sorted(v) == sorted(n) for n in names):
            assert got[i][0] == "unmatched", v


FULL = [("gender", "male", ["M", "man", "masculin", "homme", "männlich"]), ("gender", "female", ["F", "woman", "féminin", "femme", "weiblich"]), ("gender", "other", ["non-binary", "diverse", "intersex", "autre"])]
FULL += [("tumor_stage", f"Stage {s}", [s]) for s in ("I", "IA", "IB", "II", "IIA", "IIB", "III", "IIIA", "IIIB", "IIIC", "IV", "IVA", "IVB")]
FULL += [("vital_status", "alive", ["living", "vivant", "survivor", "lebend"]), ("vital_status", "dead", ["deceased", "died", "décédé", "exitus", "verstorben"]), ("vital_status", "lost to follow-up", ["LTFU", "perdu de vue", "lost"])]


@pytest.mark.parametrize(
    ("column", "pairs"),
    [
        # read by hand, not by the folding that the SQL shares
        ("gender", {" masuclin ": "male", "otrer": "other", "mascculin (self-reported)": "male", "  femaae ": "female", "MAALE": "male", "femsle?": "female", "Fémtnin": "female", "INTESEX": "other", "weislich [checked]": "female", "männlihc/": "male", "FEALE": "female", "declined": "unmatched", "inconnu": "unmatched", "ref bbvqv17": "unmatched", "not reported": "unmatched", "alive": "unmatched"}),
        ("tumor_stage", {"Stgae: 3.": "Stage III", "Satge  IIIa confirmed": "Stage IIIA", "Satge-4 A": "Stage IVA", "Satge: iiic.": "Stage IIIC", "Stgae_IIIA?": "Stage IIIA", "Stagee IVB, AJCC": "Stage IVB", "Satge_lIA (path)": "Stage IIA", "Satge lII ": "Stage III", "Stgae  three C (path)": "Stage IIIC", "Stagee: lVb": "Stage IVB", "Satge-i-b": "Stage IB", "Satge-three B": "Stage IIIB", "Stgae-lIIA": "Stage IIIA", "not staged": "unmatched", "left lobe": "unmatched", "pending mdt": "unmatched", "grade 2": "unmatched", "cf. annexe": "unmatched"}),
        ("vital_status", {"lost tofollow-uup,": "lost to follow-up", "lost ot follow-uup - confirmed": "lost to follow-up", " survior ": "alive", "verstsrben": "dead", "Deceaeed": "dead", "ALOVE": "alive", "lort tof ollow-up": "lost to follow-up", "LOST TO FOLLOWU-P": "lost to follow-up", "alite - confirmed": "alive", "loot to follow-up": "lost to follow-up", "decnased": "dead", "biopsy done": "unmatched", "consent signed": "unmatched", "--": "unmatched", "male": "unmatched"}),
    ],
)
def test_typed_values_mean_what_a_reader_takes_them_for(spark, column, pairs):
    got = mapped(spark, column, list(pairs), codes=FULL)
    assert {v: got[i][0] for i, v in enumerate(pairs)} == pairs
