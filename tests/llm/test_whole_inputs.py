"""Operators keep what long texts hold."""

from postrider.llm import pii


def test_long_contact_list_keeps_every_phone():
    phones = [f"{200 + k % 700}-{300 + k % 600}-{1000 + k}" for k in range(4000)]
    text = "\n".join(f"phone {p}," for p in phones)
    found = {text[s:e] for s, e, kind, _ in pii.find_spans(text, pii.trained_weights()) if kind == "phone"}
    assert found == set(phones)


def test_long_dotted_local_part():
    local = "anna.maria.louisa.bernadette.of.the.northern.office"
    text = f"please mail {local}(at)example.com today"
    found = [text[s:e] for s, e, kind, _ in pii.find_spans(text, pii.trained_weights()) if kind == "email"]
    assert found == [f"{local}(at)example.com"]


def test_addresses_beyond_the_segment_bound():
    for n in (5, 12, 15, 25, 400):
        local = ".".join("name" + chr(97 + i % 26) for i in range(n))
        text = f"please write to {local} [at] example [dot] com today"
        found = [text[s:e] for s, e, kind, _ in pii.find_spans(text, pii.trained_weights()) if kind == "email"]
        assert found == [f"{local} [at] example [dot] com"], n
    host = "y" + "".join(f"[dot]part{i}" for i in range(30)) + "[dot]com"
    text = f"mail x(at){host} end"
    assert [(text[s:e], kind) for s, e, kind, _ in pii.find_spans(text, pii.trained_weights())] == [(f"x(at){host}", "email")]
