"""Bare names of callees, however deep their brackets."""

from threadstone.functions.ids import bare_callee


def test_bare_callee(spark):
    want = {
        "new::<A<B<C<D>>>>": "new", "parse::<(u8,u8)>()": "parse", "self.get().run": "run", "self.get()": "get", "a::b!(x < y)": "b", "p->run(1)": "run", "f(a<b)": "f",
        "f::<fn(u8) -> Vec<u8>>(x)(y)": "f", "x.f(g(": "f", "println!": "println", "plain": "plain", "std::mem::swap::<T>": "swap", " ": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r.c: r.b for r in df.select("c", bare_callee("c").alias("b")).collect()} == want
