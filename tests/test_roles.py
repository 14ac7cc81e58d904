"""Roles, domains and entry points of hand-written files."""

import itertools

from pyspark.sql import functions as F
from test_growth import moved

from siltstone.functions.text import ordered_tokens
from siltstone.operators.marks import marked
from siltstone.operators.roles import assigned
from siltstone.plans.roles import file_roles

CASES = [
    # path, text, language, domain, role, entries
    ("api/users.py", '@app.get("/users")\ndef users():\n    pass\n', "python", "api", "HTTP API route handler", ["GET /users"]),
    ("x/otp.py", "@router.post('/otp/verify')\nasync def check(): ...\n", "python", "otp/auth", "OTP verification API route", ["POST /otp/verify"]),
    ("pay/hooks.py", 'import stripe\n@app.post("/webhook")\ndef hook(): ...\n', "python", "payments", "Stripe webhook handling", ["POST /webhook"]),
    ("w/hooks.py", '@app.post("/webhook")\ndef hook(): ...\n', "python", "api", "webhook handler", ["POST /webhook"]),
    ("jobs/mailer.py", "@shared_task\n@retry(3)\ndef send_welcome(user): ...\n", "python", "notifications", "background email task", ["Celery task: send_welcome"]),
    ("cli.py", "@cli.command()\ndef run_all(): ...\n@click.command('go')\ndef other(): ...\n", "python", "api", "CLI command", ["CLI command: run-all", "CLI command: go"]),
    ("shop/management/commands/load_it.py", "class Command(BaseCommand): ...\n", "python", "api", "Django management command", ["Django management command: load_it"]),
    ("urls.py", "urlpatterns = [path('a/', views.a), os.path.join('x')]\n", "python", "api", "Django URL routing", ["Django URL: a/ -> views.a"]),
    ("app/api/users/route.ts", "router.GET('/u', f)", "javascript", "api", "Next.js API route", ["GET /u", "Next API route: app/api/users/route.ts"]),
    ("src/components/Login.tsx", "export default function LoginForm() {}\n", "javascript", "frontend/auth", "login form UI component", ["React component: LoginForm"]),
    ("core/jwt_helper.py", "def issue(): ...\n", "python", "auth", "session/token management", []),
    ("lib/plain_text-tools.py", "class A: ...\ndef b(): ...\n", "python", None, "plain text tools classes", []),
    ("lib/more_tools.py", "def b(): ...\n", "python", None, "more tools functions", []),
    ("notes.txt", "nothing", "go", None, "notes", []),
    ("empty.py", None, "python", None, "empty", []),
    # words count wherever they stand in a text
    ("lib/long.py", "word " * 5000 + "summarize", "python", None, "offline file summary generation", []),
    # three and two against four: domains are summed; equal points go to the first name
    ("auth/jwt.py", "import jwt\nx = 'otp'\n", "python", "auth", "session/token management", []),
    ("src/tools/rank.py", "summary = 1\n", "python", "context packing", "context ranking and selection", []),
]


def test_roles_of_files(spark):
    rows = spark.createDataFrame([c[:3] for c in CASES] + [(None, "text", "python")], "path string, text string, language string")
    got = {}
    for language in ("python", "javascript", "go"):
        for r in assigned(rows.filter(rows.language == language), language).collect():
            got[r.path] = r
    assert [(path, got[path].domain, got[path].role, got[path].entries) for path, *_ in CASES] == [(c[0], *c[3:]) for c in CASES]
    assert got[None].domain is None and got[None].role is None
    assert [v.reason for v in got["auth/jwt.py"].votes] == ["path suggests auth", "imports auth library", "OTP signal", "session/token symbols"]
    assert got["api/users.py"].words == ["get", "users"]
    assert assigned(rows.limit(0), "python").count() == 0
    assert assigned(rows.withColumn("role_", rows.path), "python").columns[:4] == ["path", "text", "language", "role_"]


def test_words_of_texts_are_their_tokens(spark):
    """Words are looked for in texts as they are; case, its changes and what stands around decide as they do for tokens."""
    parts = ["otp", "Otp", "OTP", "oTp", "x", "X", "9", "_", " ", "\xe9", "K", "ran", "k", "İ", "webhook", "webhooK"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=3)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = ("otp", "rank", "webhook", "x")
    got = {r.id: set(r.w) for r in marked(rows, {}, ("text",), held={"w": ("text", words)}).collect()}
    want = {r.id: set(r.w or ()) for r in rows.select("id", F.array_intersect(ordered_tokens(F.col("text")), F.array(*map(F.lit, words))).alias("w")).collect()}
    assert got == want and sum(map(len, want.values())) > 1000


def test_roles_are_found_without_a_shuffle(spark):
    rows, shuffled = moved(spark, file_roles(spark, "/root/testdata/sf0.001"))
    assert len(rows) == 200 and shuffled == 0
