"""Added spans of secrets and personal data against values planted in sentences by another hand than the models' own."""

import random
import string

import pytest

from memspark.llm import pii, secret_scan

PROSE = (
    "the meeting moved to the second floor because the heating failed again",
    "die Lieferung kommt erst am Nachmittag und muss geprüft werden",
    "el informe se publicó ayer con dos tablas y un mapa",
    "we keep the old machine running for the archive until spring",
    "le comité a choisi la date après une longue discussion",
)


def random_secret(r):
    kind = r.randrange(5)
    if kind == 0:
        return "".join(r.choice(string.ascii_letters + string.digits + "!#%&*+-_") for _ in range(r.randint(12, 24)))
    if kind == 1:
        return "".join(r.choice(string.ascii_letters) for _ in range(r.randint(14, 22)))
    if kind == 2:
        return "-".join("".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(5)) for _ in range(4))
    if kind == 3:
        return "sk_" + "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(24))
    return "".join(r.choice("0123456789ABCDEF") for _ in range(24))


def easy_secret(r):
    return r.choice(["password1", "changeme", "Sunshine2019", "qwertyuiop", "aaaaaaaa", "abcdefgh", "hello-world", "letmein123", "19991231", "dragonfly", "testtest", "summerday"])


CREDENTIAL = ("passphrase: {}", "pwd = {}", 'dbPassword: "{}"', "Authorization: Bearer {}", "private key -> {}", "credentials: {}", "passcode is: {}", "auth-key={}")


@pytest.fixture(scope="module")
def secret_rows():
    r = random.Random(21)
    rows = []
    for _ in range(600):
        strong = r.random() < 0.5
        value = random_secret(r) if strong else easy_secret(r)
        head = r.choice(PROSE) + ". "
        lead, tail = r.choice(CREDENTIAL).split("{}")
        text = f"{head}{lead}{value}{tail} and {r.choice(PROSE)}"
        start = len(head) + len(lead)
        rows.append((text, start, start + len(value), strong))
    return rows


def test_planted_secrets(secret_rows):
    hit = false = wanted = 0
    for text, start, end, strong in secret_rows:
        got = [(a, b) for k, a, b in secret_scan.spans(text)]
        covered = any(a <= start and end <= b for a, b in got)
        wanted += strong
        hit += strong and covered
        # a fixed pattern may take an easy value; only the method's own spans count here
        false += not strong and any(k == "guess" for k, *_ in secret_scan.spans(text))
    assert hit / wanted >= 0.95
    assert hit / (hit + false) >= 0.95


def personal(r):
    d = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    return r.choice(
        [
            lambda: ("call me at ", f"{d(3)}-{d(3)}-{d(4)}"),
            lambda: ("my phone is ", f"({d(3)}) {d(3)}-{d(4)}"),
            lambda: ("Telefon: ", f"0{d(3)} {d(4)}{d(3)}"),
            lambda: ("ssn ", f"{d(3)}-{d(2)}-{d(4)}"),
            lambda: ("born on ", f"{r.randint(10, 28)}.{r.randint(10, 12)}.19{d(2)}"),
            lambda: ("write to ", f"{r.choice(['mia', 'otto.k', 'j-lopez'])} (at) {r.choice(['verein', 'mail', 'casa'])}.{r.choice(['de', 'org', 'es'])}"),
            lambda: ("IBAN ", pii._iban(r)),
        ]
    )()


def harmless(r):
    d = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    return r.choice(
        [
            lambda: ("order ", f"{d(4)}-{d(4)}"),
            lambda: ("page ", f"{d(3)} of {d(4)}"),
            lambda: ("in the year ", f"20{d(2)} and 19{d(2)}"),
            lambda: ("it cost $", f"{d(3)}.{d(3)}.{d(3)}"),
            lambda: ("on ", f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
            lambda: ("invoice ", d(10)),
            lambda: ("they looked ", "at the door . then left"),
        ]
    )()


def test_planted_personal_data():
    r = random.Random(22)
    judge = pii.model()
    hit = false = wanted = 0
    for _ in range(600):
        good = r.random() < 0.5
        lead, value = personal(r) if good else harmless(r)
        head = r.choice(PROSE) + ", "
        text = f"{head}{lead}{value}, {r.choice(PROSE)}"
        start, end = len(head) + len(lead), len(head) + len(lead) + len(value)
        got = pii.spans(text, judge)
        wanted += good
        hit += good and any(a <= start + 1 and end - 1 <= b for _, a, b in got)
        false += not good and bool(got)
    assert hit / wanted >= 0.9
    assert hit / (hit + false) >= 0.9


def test_selection_against_brute_force():
    """Of candidates by falling score each is taken if it overlaps nothing taken: found by trying all pairs."""
    r = random.Random(23)
    judge = pii.model()
    trees, cuts = judge
    import numpy as np

    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            lead, value = (personal if r.random() < 0.7 else harmless)(r)
            parts.append(f"{r.choice([lead, '', ''])}{value}{r.choice([' ', ', ', '. ', ' / '])}")
        text = "".join(parts)
        found = pii.candidates(text)
        taken = pii.base_spans(text)
        if found:
            scores = trees.score(np.array([pii.features(text, *c) for c in found], np.float32)).tolist()
            for _, c in sorted(((-s, c) for s, c in zip(scores, found, strict=True) if s >= cuts[c[0]])):
                if all(c[2] <= a or b <= c[1] for _, a, b in taken):
                    taken.append(c)
        assert pii.spans(text, judge) == sorted(taken, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_long_and_null_texts_in_the_stage(spark):
    number = "call me at 555-123-4567 "
    long = number * 20_000
    rows = [(1, long, len(long)), (2, None, None), (3, "", 0), (4, "clean text", None), (None, number, None), (1, long, len(long))]
    out = pii.redact_stage(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_chars) for r in out if r.text is not None)
    assert len(out) == 6 and [(r.text, r.n_chars) for r in out if r.doc_id == 2] == [(None, None)]
    for missing, doc_id, text, n in got:
        assert "555" not in text
        assert n == (None if doc_id == 4 else len(text))
    assert pii.redact_stage(spark.createDataFrame([], "doc_id long, text string")).count() == 0


STRONG_VALUE = "Zx9#kL2m!Qw8"
SAID = ("auth: {}", "client_secret_value={}", "password:\n  {}", "password\t=\t{}", "<password>{}</password>", "ssh_key {}", "contraseña: {}", "Passwort: {}", "mot de passe : {}", "clave = {}", "Kennwort -> {}", '"db_password": "{}"', "mdp={}", "API_KEY='{}'")
CODE = (
    "token: https://example.com/docs/page.html", "token = request.headers.get(name)", "password = os.environ['DB_PASSWORD']", "secret: ${VAULT_SECRET_NAME}", "api_key = config.service.api.key",
    "const token = generateSecureToken(32)", "password: {{ vault_password }}", "auth = HTTPBasicAuth(user, password)", "token_url = https://login.example.org/oauth2", "private_key = load_pem_private_key(data)",
    "secret_path: /var/lib/service/secrets", "pass  # nothing to do here at all", "if token is None: raise ValueError", "credentials = service.default.credentials", "def set_password(self, password): ...",
    "the token bucket limits requests", "password must not be empty or short", "auth.login(username)", "token = tokens[position]", "Authorization header is missing",
)


@pytest.mark.parametrize("form", SAID)
def test_contexts_of_values(form):
    text = f"before it. {form.format(STRONG_VALUE)} and after"
    start = text.index(STRONG_VALUE)
    assert any(a <= start and start + len(STRONG_VALUE) <= b for _, a, b in secret_scan.spans(text))


def test_a_quoted_phrase_is_one_value():
    text = 'passphrase = "seven blue otters juggle 41 lanterns" # note'
    assert [text[a:b] for k, a, b in secret_scan.spans(text) if k == "guess"] == ["seven blue otters juggle 41 lanterns"]


def test_code_without_values_gives_no_guess():
    false = [line for line in CODE if any(k == "guess" for k, *_ in secret_scan.spans(line))]
    hits = sum(bool(secret_scan.spans(form.format(STRONG_VALUE))) for form in SAID)
    assert hits / (hits + len(false)) >= 0.9 and not false
