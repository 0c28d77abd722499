"""Reports and the bounded loop with stubs."""

import pytest

from spanloom.plans import agent as A
from spanloom.plans import report as R


@pytest.mark.parametrize("text", ['{"title": "x"}', '```json\n{"title": "x"}\n```', 'So: {"title": "x"} there'])
def test_recover(text):
    assert R.recover(text) == {"title": "x"}


def test_recover_wants_an_object():
    with pytest.raises(R.ReportError):
        R.recover("[1, 2]")


def test_report_is_clamped():
    report = R.normalised({"sections": [{"title": "a", "start_s": "-3", "end_s": 99, "citations": ["claim", {"claim": "c", "start_s": 5, "end_s": 2}]}]}, 10)
    section = report["sections"][0]
    assert (section["start_s"], section["end_s"]) == (0, 10)
    assert section["citations"] == [{"claim": "claim", "start_s": 0, "end_s": 0}, {"claim": "c", "start_s": 5, "end_s": 5}]
    assert "## a (00:00-00:10)" in R.markdown(report)


class Script:
    def __init__(self, *answers):
        self.answers, self.offered = list(answers), []

    def complete(self, messages, tools):
        self.offered.append(tools)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def says(content="", **call):
    message = {"role": "assistant", "content": content}
    if call:
        message["tool_calls"] = [{"id": "1", **call}]
    return {"message": message, "usage": {"prompt_tokens": 100, "completion_tokens": 50}}


def loop(client, calls=3, functions=None):
    tools = A.Tools(functions or {"look": lambda start_s, end_s: {"seen": end_s - start_s}}, 100)
    return A.run(client, tools, [{"name": "look"}], "system", "prompt", 100, A.Budget(calls=calls), A.Rates(read=1, written=2), sleep=lambda s: None)


def test_tools_are_called_and_priced():
    client = Script(A.ChatError("busy", 429), says(name="look", arguments='{"start_s": 0, "end_s": 5}'), says('{"title": "done"}'))
    out = loop(client)
    assert out.report["title"] == "done" and out.tool_calls == 1 and out.cost == pytest.approx(2 * 200 / 1e6)


def test_spent_budget_takes_the_tools_away():
    client = Script(says(name="look", arguments="{}"), says('{"title": "end"}'))
    loop(client, calls=1)
    assert client.offered == [[{"name": "look"}], None]


def test_repair_then_fallback():
    out = loop(Script(says("no json"), says("still none")))
    assert out.report["sections"][0]["summary"] == "no json"
    assert loop(Script(says("no json"), says('{"title": "mended"}'))).report["title"] == "mended"


def test_tool_errors_are_answers_and_results_are_kept():
    seen = []
    tools = A.Tools({"look": lambda **a: seen.append(a) or {"ok": 1}}, 100)
    assert "error" in tools.run("look", {"start_s": 0, "end_s": 90}) and "error" in tools.run("none", {})
    assert tools.run("look", {"start_s": 0, "end_s": 9}) == tools.run("look", {"end_s": 9, "start_s": 0}) and len(seen) == 1


def test_errors_that_do_not_pass_are_raised():
    with pytest.raises(A.ChatError):
        loop(Script(A.ChatError("bad", 400)))


def test_nothing_is_priced_without_rates():
    assert A.Rates().cost({"prompt_tokens": 9}) is None
    assert A.Rates(read=2, cached=1).cost({"input_tokens": 10, "cached_tokens": 99}) == pytest.approx(10 / 1e6)
