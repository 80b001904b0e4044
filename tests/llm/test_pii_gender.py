"""A given name of two people keeps their genders apart, text by text."""

import re

from tallyhound.llm import pii_surrogates as pii


def test_gender_is_that_of_the_text():
    kinds = lambda t: [k for a, b, k, *_ in pii.mentions(t) if t[a:b] == "Robin"]
    assert kinds("Mr. Robin Smith met Mrs. Robin Jones. Robin left.") == ["name.n.latin"] * 3
    assert kinds("Robin came. Mr. Robin Smith is Dr. Robin Smith. Robin left.") == ["name.m.latin"] * 4
    assert kinds("Dr. Robin Smith and Robin.") == ["name.n.latin"] * 2


def test_across_the_corpus(spark):
    texts = ["Mr. Robin Smith wrote. Robin Smith left.", "Mrs. Robin Jones wrote.", "Mr. Robin Brown again.", None, "Mr. Robin Smith wrote. Robin Smith left."]
    out = [r.text for r in pii.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key=b"k").orderBy("doc_id").collect()]
    given = lambda t: re.findall(r"Mrs?\. (\w+)", t)
    (his,), (hers,), (again,) = given(out[0]), given(out[1]), given(out[2])
    assert his == again != hers and his.endswith(pii.ENDINGS["latin"]["m"]) and hers.endswith(pii.ENDINGS["latin"]["f"])
    assert out[0].count(his) == 2 and out[0] == out[4] and out[3] is None and "Robin" not in "".join(filter(None, out))
