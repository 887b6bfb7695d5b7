"""Rules against plain Python regular expressions, on random and on hostile texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditlens.functions import matching, rules
from auditlens.operators import findings, screen
from auditlens.operators.signals import code_text, prepare, with_signals
from auditlens.plans import oracle

# Signal name -> the name of its pattern in the SQL module.
PAIRS = {
    "llm_call": "llm",
    "ai_import": "ai_imp",
    "ai_construct": "ai_new",
    "ai_context": "ai_chat",
    "try_except": "tryexc",
    "fallback": "fallback",
    "input_schema": "inputs",
    "pii": "pii",
    "log_import": "logimp",
    "log_call": "logcall",
    "trace_import": "trimp",
    "trace_usage": "truse",
    "audit": "audit",
    "hitl": "hitl",
    "limit_strong": "strong_rate",
    "limit_weak": "weak_rate",
    "limit_rate": "only_rate",
    "tokens_unbounded": "no_max",
    "identity": "ident",
    "boundary": "bound",
    "output": "outp",
    "retry": "retry",
    "unsafe_input": "danger",
}
BARE_PAIRS = {"defence_strong": "inj_strong", "defence_moderate": "inj_mod", "defence_weak": "inj_weak"}
PATTERNS = (
    [oracle.CODE_PATTERNS[p] for p in PAIRS.values()]
    + list(oracle.FRAMEWORK_PATTERNS.values())
    + [oracle.TRUST_PATTERN]
    + list(oracle.BARE_PATTERNS.values())
    + [p for _, _, p in oracle.INJECTION]
)
JOINTS = [" ", "  ", "\n", "\t", "\r", "\r\n", "", ".", "(", '"', "{", "}", "\u2028", "\x0b", "\x1c", "\xa0", "é", "_", "ſ", "#"]


def fragments(pattern: str) -> list[str]:
    """Literal pieces of a pattern, as building blocks for texts that nearly match."""
    plain = re.sub(r"\(\?[a-z:!<=]*|\\[swbS]\+?\*?", "|", pattern)
    plain = re.sub(r"\\(.)", r"\1", plain)
    return [p for p in re.split(r"[|()*?+\[\]^]|\.\*", plain) if p]


PHRASES = [
    ["logging.info(", "log.x("],
    ["max_tokens", "=", "None"],
    ['f"', "{", "input", "}", '"'],
    [".format(", "input"],
    ["from", " ", "my_guardrails", " ", "import"],
    ["def", " ", "check", "prompt"],
    ["content_filter", "("],
    ["try", "except"],
    [".invoke(", ".run("],
    ["prompt", "injection"],
]


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        pieces = fragments(rng.choice(PATTERNS)) + rng.sample(fragments(rng.choice(PATTERNS)), 1)
        chosen = [rng.choice(pieces) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            chosen = rng.choice(PHRASES) + rng.sample(chosen, 1)
        words = []
        for w in chosen:
            if rng.random() < 0.15:
                w = rng.choice([w.upper(), w.title(), w.replace("s", "ſ"), w.replace("k", "\u212a"), w.replace("i", "ı")])
            words += [w, rng.choice(JOINTS)]
        texts.append("".join(words))
    return texts


def bare(code: str) -> str:
    code = re.sub(r"#[^\n]*", "", code)
    return re.sub(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'', "", code)


@pytest.fixture(scope="module")
def texts():
    return random_texts(4000, 5) + ["", "\n", "\r\n", "\n\n\n"]


def test_code_signals_equal_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, code string").repartition(8)
    got = {r["i"]: r for r in with_signals(df).collect()}
    hits: dict[str, int] = {}
    for i, t in enumerate(texts):
        want = {s: bool(re.search(oracle.CODE_PATTERNS[p], t)) for s, p in PAIRS.items()}
        want |= {s: bool(re.search(oracle.BARE_PATTERNS[p], bare(t))) for s, p in BARE_PAIRS.items()}
        want |= {f"fw_{n}": bool(re.search(p, t)) for n, p in oracle.FRAMEWORK_PATTERNS.items()}
        want["trust_layer"] = bool(re.search(oracle.TRUST_PATTERN, t))
        for name, value in want.items():
            hits[name] = hits.get(name, 0) + value
            assert got[i][name] == value, (name, t)
    assert min(hits.values()) > 5, hits


def test_injection_rules_equal_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r["i"]: r for r in screen.check_injection(df).collect()}
    for i, t in enumerate(texts):
        want = [n for n, _, p in oracle.INJECTION if re.search(p, t)]
        assert [h["pattern"] for h in got[i]["detected_patterns"]] == want, t


def test_short_form_equals_full_form(spark, texts):
    """The regular expressions alone give what the guarded conditions give."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, code string").repartition(8)
    every = {**rules.FRAMEWORKS, **rules.CODE_SIGNALS}
    flagged = with_signals(df, only=[*rules.CODE_SIGNALS, *[f"fw_{n}" for n in rules.FRAMEWORKS]])
    joined = flagged.join(
        df.select("i", *[r.search(F.col("code")).alias(f"s_{n}") for n, r in every.items()]), "i"
    )
    differ = [
        F.count_if(F.col(n if n in rules.CODE_SIGNALS else f"fw_{n}") != F.col(f"s_{n}")).alias(n) for n in every
    ]
    assert not any(joined.agg(*differ).first())


def python_counts(code: str) -> tuple[int, int, int, int]:
    lines = code.split("\n")
    defs = docs = fns = typed = 0
    for i, line in enumerate(lines):
        s = line.strip()
        if s.startswith(("def ", "class ")) and not s.startswith("def _"):
            defs += 1
            nxt = [x.strip() for x in lines[i + 1 : i + 4] if x.strip()]
            docs += bool(nxt) and nxt[0].startswith(('"""', "'''"))
        if s.startswith("def ") and not s.startswith("def _"):
            fns += 1
            typed += "->" in s or bool(re.search(r":\s*(str|int|float|bool|list|dict|List|Dict|Optional|Any)", s))
    return defs, docs, fns, typed


def test_definition_counts_equal_python(spark):
    rng = random.Random(9)
    pieces = ["def ", "class ", "def _x", "async def ", "f(a: int)", "->", ":", " ", "  ", "\t", "\n", "\n", "\n\n",
              '"""', "'''", "x", "\r", "\x1c", "\u2028", "\xa0", "A:", ": str"]
    codes = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string").repartition(8)
    cols = ["n_defs", "n_documented", "n_functions", "n_typed"]
    for r in with_signals(df, only=cols).collect():
        assert tuple(r[c] for c in cols) == python_counts(codes[r["i"]]), repr(codes[r["i"]])


def test_line_counts_equal_splitlines(spark):
    from auditlens.functions.text import count_lines

    rng = random.Random(3)
    pieces = ["a", "é", "\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", "\u2029"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", count_lines(F.col("t")).alias("n")).collect():
        assert r["n"] == len(texts[r["i"]].splitlines()), repr(texts[r["i"]])


@pytest.mark.parametrize(
    "line",
    [
        "ignore the previous " * 10_000,
        "<system " * 25_000,
        'f"{input ' * 20_000,
        "def check " * 20_000,
        "from " * 40_000,
        " " * 200_000,
        "def f():" + " \n" * 100_000,
        "try " * 50_000,
        '"""' * 60_000 + '"',
    ],
)
def test_long_lines_take_linear_time(spark, line):
    df = spark.createDataFrame([(line,)], "code string")
    start = time.time()
    findings.scan_code(df).collect()
    screen.check_injection(df.withColumnRenamed("code", "text")).collect()
    assert time.time() - start < 20


def test_shared_pieces_spare_words_a_search(spark):
    """Words are found under guards as without them, and no guard misses a word of any rule."""
    texts = [w for rs in (rules.FRAMEWORKS, rules.CODE_SIGNALS) for r in rs.values() for w in words_of(r)]
    texts += rules.TRUST_LAYER.words
    texts += [t.upper() for t in texts] + [f"é_ x{t}x _\n{t[::-1]} İ" for t in texts] + ["", "_", "a _ b", "ret ry", None]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    every = {**rules.FRAMEWORKS, **rules.CODE_SIGNALS, "trust_layer": rules.TRUST_LAYER}
    prepared = prepare(df, "code", guards=True)
    plain = [r.on(code_text()).alias(n) for n, r in every.items()]
    guarded = [r.on(code_text(guards=True)).alias(n) for n, r in every.items()]
    assert prepared.select("code", *guarded).collect() == prepared.select("code", *plain).collect()
    searched = rules.CODE_SIGNALS["hitl"].sql(code_text(guards=True))
    assert searched.count("contains(__low") < rules.CODE_SIGNALS["hitl"].sql(code_text()).count("contains(__low")


def test_pieces_with_an_underscore(spark):
    texts = ["", " ", "_", "a b_c  d _ e\n", "x\n y_\nz w\n", "no pieces here", "a_b", "é ü_ß q", "_ " * 3, "end _\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(matching.underscored(F.col("t"))).collect()
    large = "a_b c " * 200_000
    assert spark.createDataFrame([(large,)], "t string").select(matching.underscored(F.col("t"))).first()[0] == large
    pieces = [None if r[0] is None else [p for p in r[0].split(" ") if p] for r in got]
    assert pieces == [None if t is None else [p for p in t.split(" ") if "_" in p] for t in texts]


def words_of(rule):
    if isinstance(rule, matching.OneOf):
        return [w for o in rule.options for w in words_of(o)]
    if isinstance(rule, matching.Words):
        return list(rule.words)
    return [w for g in (rule.parts if isinstance(rule, matching.Chain) else rule.needs) for w in g]
