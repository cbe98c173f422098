"""Random keys behind names and with separators, and ordinary tokens of the same form."""

import random

from tallyward.llm import secrets


def test_keys_in_other_forms_are_tested(spark):
    rng = random.Random(11)

    def key(alphabet, n):
        return "".join(rng.choice(secrets.ALPHABETS[alphabet]) for _ in range(n))

    def grouped(token, size, mark):
        return mark.join(token[i : i + size] for i in range(0, len(token), size))

    forms = {
        "named": lambda: (f"sig={(k := key('base36', 36))}", k),
        "named hex": lambda: (f"auth={(k := key('hex', 23))}", k),
        "named base32": lambda: (f"STRIPE_KEY={(k := key('base32', 32))}", k),
        "grouped hex": lambda: ((k := grouped(key("hex", 32), 8, "-")), k),
        "lower with dashes": lambda: ((k := grouped(key("base36", 40), 10, "-")), k),
        "upper with underscores": lambda: ((k := grouped(key("BASE36", 40), 10, "_")), k),
        "padded": lambda: ((k := key("base64", 50) + "=="), k),
    }
    rows, keys = [], {}
    for form, make in forms.items():
        for _ in range(40):
            written, value = make()
            keys[len(rows)] = form, written.index(value) + 4, value
            rows.append((len(rows), f"see {written} there"))
    plain = [f"see some-ordinary-file-name-of-part-{i}-here and level_{i}_of_the_common_house=the-name-of-the-other-{i}-thing" for i in range(20)]
    rows += [(1000 + i, t) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.stop) for s in r.found if s.kind == 3] for r in secrets.secret_spans(docs, ["doc_id"]).collect()}
    hits = {form: sum((at, at + len(k)) in got[i] for i, (f, at, k) in keys.items() if f == form) for form in forms}
    assert all(n >= 28 for n in hits.values()), hits
    assert not any(got[1000 + i] for i in range(20))
