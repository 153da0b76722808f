import random

from ledgerloom.llm import secrets


def test_hex_after_a_joined_prefix_is_covered(spark):
    rng = random.Random(2)
    texts, keys = [], []
    for prefix in ("SIGNATURE=", "sig-", "path/", "Key_", ""):
        for letters in ("0123456789ABCDEF", "0123456789abcdefABCDEF"):
            for n in (32, 40, 64):
                key = "".join(rng.choice(letters) for _ in range(n))
                texts.append(f"see {prefix}{key} there")
                keys.append(key)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    whole = [i for i, key in enumerate(keys) if not any(key[j : j + 8] in out[i] for j in range(len(key) - 7))]
    assert len(whole) == len(keys), [out[i] for i in range(len(keys)) if i not in whole]


def test_harmless_runs_inside_candidates_stay(spark):
    texts = ["v-" + "a" * 30 + "1", "x/d41d8cd98f00b204e9800998ecf8427e", "n_" + "1234567890" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find(df).collect():
        assert [s for s in r.secrets if s.kind == 3] == []
