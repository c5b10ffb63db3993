import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import ids, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column).first()[0]


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_ids(spark):
    assert one(spark, ids.chunk_id(F.lit("héllo"))) == "chunk-" + md5("\0héllo")
    assert one(spark, ids.entity_id(F.lit("a"), F.lit("B"))) == "ent-" + md5("\0a - B")
    assert one(spark, ids.relation_id(F.lit("s"), F.lit("o"), F.lit("T"))) == "rel-" + md5("\0s -> oT")
    assert one(spark, ids.community_id(F.lit(1), F.lit(7))) == "com-" + md5("\0" + "1:7")
    assert one(spark, ids.content_hash(F.lit("x"), named={"b": F.lit(2), "a": F.lit(1)})) == md5("\0x\0a\x011\0b\x012")
    assert one(spark, ids.named_uuid("col", F.lit("key"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "col:key"))


def test_descriptions(spark):
    merged = one(spark, text.merge_descriptions(F.array(F.lit("One fact. Two  facts!"), F.lit("ONE FACT.\nthree"))))
    assert merged == "One fact. Two facts! three"


@pytest.mark.parametrize("raw,key", [("storm-event", "STORM_EVENT"), (" a  b (x) (y)", "A_B"), ("", "")])
def test_type_key(spark, raw, key):
    assert one(spark, text.type_key(F.lit(raw))) == key


def test_small_ones(spark):
    assert one(spark, text.clean_type(F.lit(" City (big)"))) == "City" and one(spark, text.clean_type(F.lit(" "))) == "UNKNOWN"
    assert one(spark, text.label_name(F.lit("9 lives!"))) == "_9_lives_" and one(spark, text.label_name(F.lit(" "))) == "ENTITY"
    assert one(spark, text.words(F.lit("The 42 Cats, a dog"), stop=["the"])) == ["cats", "dog"]
    assert one(spark, text.first_words(F.lit("a b c d"), 2)) == "a b" and one(spark, text.preview(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, text.render("Hi {{ name }}, {{n}}!", name=F.lit("Ann"), n=F.lit(3))) == "Hi Ann, 3!"
    with pytest.raises(KeyError):
        text.render("{{ missing }}")
    assert one(spark, text.splice_before_last(F.array(F.lit("s"), F.lit("u")), F.array(F.lit("x")))) == ["s", "x", "u"]
    assert one(spark, text.close_match(["PERSON", "PLACE"])(F.lit("PERSN"))) == "PERSON"
    assert [one(spark, text.language(F.lit(t))) for t in ("the cat and the dog", "der Hund und die Katze", "это кот", "猫です", "xyz")] == ["en", "de", "ru", "ja", "und"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.normalise(F.col("a")), vectors.decode_float32(vectors.encode_float32("a"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[1][0] is None
    assert np.allclose(got[0][1], [0.6, 0.8]) and got[1][1] == [0, 0] and got[0][2] == [3, 4]
    with pytest.raises(Exception, match="length 3 expected"):
        df.select(vectors.require_dim(F.col("a"), 3)).collect()
