"""SCL-09 / SCL-10: JVM vector expressions against NumPy (hypothesis)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from issuelens.functions.vectors import inner_product, l2_norm, normalize

FLOATS = st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, width=32)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(FLOATS, min_size=4, max_size=4),
                          st.lists(FLOATS, min_size=4, max_size=4)), min_size=1, max_size=20))
def test_vector_expressions(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "i int, a array<float>, b array<float>")
    rows = df.select("i", inner_product("a", "b").alias("ip"), l2_norm("a").alias("n"),
                     normalize("a").alias("u")).orderBy("i").collect()
    for (a, b), r in zip(pairs, rows):
        A = np.asarray(a, dtype=np.float32).astype(np.float64)
        B = np.asarray(b, dtype=np.float32).astype(np.float64)
        assert np.isclose(r["ip"], float(A @ B), rtol=1e-9, atol=1e-6)
        n = float(np.linalg.norm(A))
        assert np.isclose(r["n"], n, rtol=1e-9, atol=1e-9)
        u = np.asarray(r["u"], dtype=np.float64)
        if n > 0:
            assert np.allclose(u, (A / n).astype(np.float32), rtol=1e-6, atol=1e-7)
        else:
            assert not u.any()                      # a zero vector stays zero
