import pytest

from tessera.sources.model_calls import CallFailed, CallPolicy, Reply, ask_model


def scripted(*steps):
    """A sender that plays these steps, and the calls it got."""
    seen, left = [], list(steps)

    def send(prompt, tokens):
        seen.append(tokens)
        step = left.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    return send, seen


@pytest.mark.parametrize(
    "steps, answer, tokens, waits, error",
    [
        ([Reply(' {"a": 1} ')], '{"a": 1}', [100], [], None),
        ([CallFailed("down", 503), CallFailed("slow down", 429), Reply("ok")], "ok", [100, 16384, 16384], [1.0, 2.0], None),
        ([CallFailed("bad key", 401)], None, [100], [], "bad key"),
        ([Reply(""), Reply(None), Reply("  ")], None, [100, 16384, 16384], [1.0, 2.0], "the answer was empty"),
        ([Reply('{"a": 1', cut_off=True), Reply('{"a": [1, 2]}', cut_off=True)], '{"a": [1, 2]}', [100, 16384], [1.0], None),
        ([CallFailed("reset")] * 3, None, [100, 16384, 16384], [1.0, 2.0], "reset"),
    ],
)
def test_policy(steps, answer, tokens, waits, error):
    send, seen = scripted(*steps)
    slept = []
    got = CallPolicy(max_tokens=100).call(send, "p", slept.append)
    assert got == (answer, len(seen), error) and seen == tokens and slept == waits


def test_budgets_are_bounded():
    assert list(CallPolicy(8192).budgets()) == [8192, 16384, 16384] and list(CallPolicy(20_000).budgets())[1] == 32_768
    send, seen = scripted(Reply('{"a', cut_off=True))
    assert CallPolicy(32_768).call(send, "p", lambda s: None) == (None, 1, "the answer was cut off")


def test_prompts_of_a_frame(spark):
    def connect():
        def send(prompt, tokens):
            if prompt == "bad":
                raise CallFailed("no", 400)
            return Reply(prompt.upper())

        return send

    prompts = spark.createDataFrame([("a", "x", 1), ("b", "bad", 1), ("c", None, 1), (None, "y", 1)], "document_id string, prompt string, attempts int")
    got = {(r.document_id, r.response_json, r.attempts, r.error) for r in ask_model(prompts, connect).collect()}
    assert got == {("a", "X", 1, None), ("b", None, 1, "no"), ("c", None, 0, "no prompt"), (None, "Y", 1, None)}
    assert ask_model(prompts.limit(0), connect).count() == 0
