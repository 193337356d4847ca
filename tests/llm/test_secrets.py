"""The lexer on the syntaxes that it reads, and on texts that must not be marked or take long."""

import time

import pytest

from tagweft.llm import secrets

K, V = "Zx81kQ9vT3mm", "Kq47Rp20wLx"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"k = '{K}'\npwd = k + '{V}'", [K, V]),
        (f"<db_pwd>{K}</db_pwd>", [K]),
        (f"<a><passphrase>\n {K} </passphrase></a>", [K]),
        (f"pwd => '{K}'", [K]),
        (f"'db_pwd' => \"{K}\"", [K]),
        (f"db_pwd: str = '{K}'", [K]),
        (f"db_pwd: Optional[str] = '{K}'", [K]),
        (f"const dbPwd: string = `{K}`;", [K]),
        (f"db_pwds = ['{K}', \"{V}\"]", [K, V]),
        (f"db_pwds = (\n    '{K}',\n    '{V}',\n)", [K, V]),
        (f"setPwd('{K}')", [K]),
        (f"client.set_credentials(\"{K}\")", [K]),
        (f"db_pwd = f'{K}'", [K]),
        (f"db_pwd = rb\"{K}\"", [K]),
        (f"x = {{'db_pwd': ('{K}')}}", [K]),
        (f"db_pwd = late\nlate = '{K}'", [K]),
        (f"const db_pwd = process.env.X || '{K}'", [K]),
        (f"db_pwd = os.environ.get or '{K}'", [K]),
        (f"[section]\ndb_pwd = {K}\n", [K]),
        (f"export DB_PWD={K}", [K]),
        (f"db_pwd: {K}\n", [K]),
    ],
)
def test_syntaxes(text, want):
    assert [text[a:b] for a, _, b in secrets.literal_spans(text, [])] == want


@pytest.mark.parametrize("text", [f"name = '{K}'", f"get_pwd('{K}')", "<pwd></pwd>", f"<pwd>{K}</other>", f"f(x='{K}')", "db_pwd = other\nother = 'changeme1'", f"if pwd == '{K}':", "pwd: str", "db_pwd = []"])
def test_what_is_no_secret(text):
    assert secrets.literal_spans(text, []) == []


@pytest.mark.parametrize("unit", ["a=", "a=[", "a=['b',", "a:b=", "a=b+", "<a>", "<a>b", "a=b||'", "set_pwd(", "a=('=('", "pwd: x = ", "=>", "a\n=", "db_pwd = late\n"])
def test_linear_in_the_text(unit):
    took = []
    for n in (20_000, 80_000):
        started = time.process_time()
        secrets.literal_spans(unit * (n // len(unit)), [])
        took.append(time.process_time() - started)
    assert took[1] < 12 * took[0] + 0.3, took
