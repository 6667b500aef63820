"""Price list parsing, ranked name lookup and cost arithmetic."""

import random

from conftest import prices_from, usage_rows

from ledgerline.operators.pricing import attach_rates, norm_index, price_rows, resolve_models
from ledgerline.operators.aggregate import usage_aggregate

PRICES = {
    "sample_spec": {"input_cost_per_token": 1.0},
    "claude-opus-4-7": {"input_cost_per_token": 5e-06, "output_cost_per_token": 2.5e-05},
    "anthropic/claude-haiku-4-5": {"input_cost_per_token": 1e-06, "output_cost_per_token": 5e-06},
    "gpt-4o": {"input_cost_per_token": 2.5e-06, "output_cost_per_token": 1e-05},
    "gemini/gemini-2.5-flash": {"input_cost_per_token": 3e-07, "output_cost_per_token": 2.5e-06},
    "o3": {"input_cost_per_token": 2e-06, "output_cost_per_token": 8e-06},
    "o3-20250416": {"input_cost_per_token": 9e-06, "output_cost_per_token": 9e-06},
    "zero-model": {"input_cost_per_token": 0, "output_cost_per_token": 0, "output_cost_per_reasoning_token": 1e-06},
    "bad-model": {"input_cost_per_token": "cheap"},
    "not-an-object": 7,
}


def resolve(spark, names, prices=PRICES):
    models = spark.createDataFrame([(n,) for n in names], "model string")
    got = resolve_models(models, prices_from(spark, prices)).collect()
    return {r.model: r.price_key for r in got}


def test_price_list_skips_sample_bad_and_zero_entries(spark):
    keys = {r.key for r in prices_from(spark, PRICES).collect()}
    assert "sample_spec" not in keys
    assert "bad-model" not in keys and "not-an-object" not in keys
    assert "zero-model" not in keys  # reasoning rate alone does not keep an entry
    assert {"claude-opus-4-7", "gpt-4o", "o3", "o3-20250416"} <= keys


def test_name_variants_resolve(spark):
    got = resolve(spark, [
        "claude-opus-4-7", "claude-opus-4-7-20260101", "claude-opus-4.7", "CLAUDE-OPUS-4-7",
        "claude-haiku-4-5", "gpt-4o-latest", "openrouter/openai/gpt-4o", "gemini-2.5-flash", "o3-2025-04-16",
    ])
    assert got["claude-opus-4-7"] == "claude-opus-4-7"
    assert got["claude-opus-4-7-20260101"] == "claude-opus-4-7"  # date stamp
    assert got["claude-opus-4.7"] == "claude-opus-4-7"  # "." -> "-"
    assert got["CLAUDE-OPUS-4-7"] == "claude-opus-4-7"  # case
    assert got["claude-haiku-4-5"] == "anthropic/claude-haiku-4-5"  # provider prefix
    assert got["gpt-4o-latest"] == "gpt-4o"  # -latest
    assert got["openrouter/openai/gpt-4o"] == "gpt-4o"  # path suffix
    assert got["gemini-2.5-flash"] == "gemini/gemini-2.5-flash"
    assert "o3-2025-04-16" not in got  # not a 20dddddd stamp


def test_misses_are_never_zero_cost(spark):
    got = resolve(spark, ["", "totally-unknown-model", "zero-model", "bad-model"])
    assert got == {}


def test_norm_index_prefers_shortest_key(spark):
    idx = {r.norm: r.key for r in norm_index(prices_from(spark, PRICES)).collect()}
    assert idx["o3"] == "o3"


def test_cost_arithmetic(spark):
    prices = prices_from(spark, {
        "m1": {"input_cost_per_token": 1e-06, "output_cost_per_token": 2e-06, "cache_read_input_token_cost": 1e-07,
               "cache_creation_input_token_cost": 5e-07},
        "m2": {"input_cost_per_token": 1e-06, "output_cost_per_token": 2e-06, "output_cost_per_reasoning_token": 5e-06},
        "m3": {"input_cost_per_token": 1e-06, "output_cost_per_token": 2e-06},
    })
    from conftest import T0

    usage = usage_rows(spark, [
        dict(source="a", dedup_key="1", ts=T0, model="m1", input=1_000_000, output=500_000, cache_read=2_000_000,
             cache_write=100_000),
        dict(source="a", dedup_key="2", ts=T0, model="m2", output=100, reasoning=20),
        dict(source="a", dedup_key="3", ts=T0, model="m3", output=100, reasoning=20),
    ])
    rows = price_rows(attach_rates(usage_aggregate(usage, "model"), prices)).collect()
    cost = {r.model: r.cost for r in rows}
    assert abs(cost["m1"] - 2.25) < 1e-12
    assert abs(cost["m2"] - 0.0003) < 1e-15
    assert abs(cost["m3"] - 0.00024) < 1e-15  # reasoning falls back to the output rate


# A sequential statement of the lookup rules, used as a differential check.
def _norm(n):
    import re

    n = n.strip().lower()
    n = re.sub(r"[-@]20\d{6}\Z", "", n)
    for suf in ("-latest", ":free", "-free"):
        if n.endswith(suf):
            n = n[: -len(suf)]
    return n


def _cands(model):
    import re

    m = model.strip()
    out = []
    for c in [m, m.lower()] + ["/".join(m.split("/")[i:]) for i in range(1, len(m.split("/")))]:
        if c and c not in out:
            out.append(c)
    if "/" not in m:
        for p in ["anthropic/", "openai/", "gemini/", "vertex_ai/", "openrouter/"]:
            if p + m not in out:
                out.append(p + m)
    if "." in m and m.replace(".", "-") not in out:
        out.append(m.replace(".", "-"))
    if re.search(r"(\d)-(\d+)\Z", m):
        alt = re.sub(r"(\d)-(\d+)\Z", r"\1.\2", m)
        if alt not in out:
            out.append(alt)
    return [c for c in out if c]


def _resolve_seq(model, keys):
    if model == "":
        return None
    for c in _cands(model):
        if c in keys:
            return c
    index = {}
    for k in sorted(keys, key=lambda k: (len(k.encode()), k)):
        index.setdefault(_norm(k), k)
    for c in _cands(model):
        if _norm(c) in index:
            return index[_norm(c)]
    return None


def test_lookup_matches_sequential_statement(spark):
    rnd = random.Random(7)
    keys = [k for k in PRICES if k not in ("sample_spec", "bad-model", "not-an-object", "zero-model")]
    parts = ["claude", "opus", "4", "7", "gpt", "4o", "o3", "gemini", "2.5", "flash", "haiku", "5"]
    names = set()
    for _ in range(300):
        n = "-".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
        n = rnd.choice(["", "anthropic/", "openai/", "x/y/"]) + n
        n += rnd.choice(["", "-latest", "-20250101", ":free", "@20240101"])
        names.add(rnd.choice([n, n.upper(), " " + n + " "]))
    names |= {k for k in keys}
    got = resolve(spark, sorted(names))
    for n in names:
        assert got.get(n) == _resolve_seq(n, set(keys)), n


def test_price_list_file_reader_and_handle_reuse(spark, tmp_path):
    import json

    from ledgerline.sources.prices import SAMPLE_PRICES, read_price_list

    p = tmp_path / "prices.json"
    p.write_text(json.dumps(PRICES))
    keys = {r.key for r in read_price_list(spark, str(p)).collect()}
    assert keys == {"claude-opus-4-7", "anthropic/claude-haiku-4-5", "gpt-4o", "gemini/gemini-2.5-flash", "o3",
                    "o3-20250416"}
    assert read_price_list(spark) is read_price_list(spark)  # one handle per session and path
    sample = {r.key for r in read_price_list(spark, SAMPLE_PRICES).collect()}
    assert "sample_spec" not in sample and "deepseek-chat" not in sample and "qwen3-coder:free" not in sample
