from pyspark.sql import functions as F

from triagewright.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_steps(spark):
    c = F.col("c")
    assert one(spark, T.norm_step(c), c='  And  user clicks  "A 1"\t now ') == 'user clicks "a 1" now'
    assert one(spark, T.norm_step(c), c="Then When x") == "when x"
    assert one(spark, T.norm_step(c), c=None) is None
    assert one(spark, T.norm_step(c), c=" \t") == ""


def test_exceptions(spark):
    c = F.col("c")
    assert one(spark, T.simple_exception(c), c="at x: org.a.B.TimeoutException: y SomeError") == "TimeoutException"
    assert one(spark, T.simple_exception(c), c="AssertionErrors") is None
    assert one(spark, T.simple_exception(c), c="connection refused") is None


def test_locators(spark):
    c = F.col("c")
    assert one(spark, T.grouping_locator(c), c="By.xpath: \"//a  [1]\" and resource-id='card_1047'") == "card_1047"
    assert one(spark, T.grouping_locator(c), c="By.id: 'save  button', more") == "save button"
    assert one(spark, T.feedback_locator(c), c="By.id: 'save button', more") == "'save button'"
    assert one(spark, T.grouping_locator(c), c="xpath = //div") == "//div"
    assert one(spark, T.feedback_locator(c), c="xpath = //div") is None
    assert one(spark, T.grouping_locator(c), c="nothing") == ""
    assert [one(spark, T.is_dynamic_locator(c), c=x) for x in ("card_123", "a[2]", "x1234", "card_12", None)] == [True, True, True, False, False]
    assert one(spark, T.locator_pattern(c), c=" A[3]  b_4567 ") == "a[#] b_<num>"


def test_error_bodies_and_frames(spark):
    error = "Expected [12] for 'abc' at card_9\r\nsecond"
    assert one(spark, T.error_body(F.col("e"), F.col("l")), e=error, l="card_9") == 'expected [#] for "*" at *'
    assert one(spark, T.error_body(F.col("e"), F.col("l")), e=" ", l="") == "no-error"
    stack = "x\n  at io.cucumber.Run.go(Run.java:3)\n\tat app.Steps.tap(Steps.java:80)\nat z"
    assert one(spark, T.top_frame(F.col("s")), s=stack) == "at app.steps.tap(steps.java)"
    assert one(spark, T.top_frame(F.col("s")), s="at io.cucumber.A(B:1)") == "at io.cucumber.a(b)"
    assert one(spark, T.stack_pattern(F.col("s")), s="\n  \n  first \nsecond") == "first"


def test_ids_mask_numbers_and_ignore_scenarios(spark):
    a = "org.x.NoSuchElementException: resource-id=card_104712 [3] 123e4567-e89b-12d3-a456-426614174000"
    b = a.replace("104712", "999999").replace("[3]", "[8]").replace("123e", "923e")
    ident = T.failure_id(F.col("s"), F.col("e"))
    assert one(spark, ident, s="And tap", e=a) == one(spark, ident, s="and  TAP", e=b)
    assert one(spark, ident, s="And tap", e=a) != one(spark, ident, s="tap", e=a)
    assert len(one(spark, ident, s=None, e=None)) == 16
    old = T.legacy_failure_id(F.lit("s"), F.lit("f"), F.col("s"), F.col("e"))
    assert one(spark, old, s="tap", e=a) != one(spark, ident, s="tap", e=a)


def test_noise_and_limits(spark):
    stack = "E\nCapabilities {a: 1,\nb}\nBuild info: x\n" + "\n".join(f"at f{i}" for i in range(10)) + "\ntail"
    assert one(spark, T.strip_stack_noise(F.col("s")), s=stack) == "E\n" + "\n".join(f"at f{i}" for i in range(8)) + "\ntail"
    assert one(spark, T.limit_text(F.col("s"), 3), s=" abcd ") == "abc\n[TRUNCATED]"
    assert one(spark, T.limit_text(F.col("s"), 3), s=" ") == "NOT PROVIDED"
    assert one(spark, T.stack_section(F.col("a"), F.col("b")), a="E\nat x", b=" E\nat x ").startswith("Same content")
    steps = "\n".join(f"{i}. s" for i in range(1, 31))
    shown = one(spark, T.format_steps(F.lit(None).cast("array<string>"), F.col("s")), s=steps)
    assert shown.startswith("[... 5 earlier step(s) omitted for brevity ...]\n6. s") and shown.endswith("30. s")
    assert one(spark, T.format_steps(F.array(F.lit("a"), F.lit("b")), F.col("s")), s=steps) == "1. a\n2. b"


def test_cluster_signature(spark):
    sig = T.cluster_signature(F.col("k"), F.col("f"), F.col("s"), F.col("e"), F.lit(True))
    assert one(spark, sig, k=" API_ISSUE ", f=None, s="Tap 'Pay'!", e="waited 30 seconds") == "API_ISSUE|UNKNOWN|tap pay|waited timeout"
