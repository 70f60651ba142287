"""Text expressions for search and naming."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries leave out.
STOP_WORDS = (
    "a an and are as at be but by can do does for from had has have how i if in into is it its me my no not of on or our so than that the their them then "
    "there these they this to up us was we were what when where which who whom why will with would you your find show list get set all each every any some "
    "about also between through should could just only look tell give make use work works working"
).split()

# Label of a flow by the first pattern in its name.
FLOW_LABELS = [
    ("Initialization", "init bootstrap setup"), ("Shutdown", "shutdown cleanup teardown dispose close"), ("Test flow", "test bench"), ("Server", "serve listen accept"),
    ("Request handler", "handle handler endpoint middleware"), ("Router", "route dispatch"), ("Create operation", "create insert add new"), ("Update operation", "update modify patch set"),
    ("Delete operation", "delete remove destroy drop"), ("Read operation", "get fetch load read find lookup query"), ("List operation", "list scan iterate enum"), ("Processing", "process execute run eval"),
    ("Parser", "parse decode unmarshal deserialize"), ("Serializer", "format encode marshal serialize render"), ("Transformer", "convert transform map"), ("Copy operation", "copy clone dup"),
    ("Merge operation", "merge combine join"), ("Validation", "valid check verify"), ("Authentication", "auth login permit acl"), ("Synchronization", "sync reconcil replicat"),
    ("Scheduler", "schedule plan allocat"), ("Watcher", "watch monitor poll subscribe"), ("Event emitter", "emit publish notify broadcast event"), ("Observability", "log metric trace audit"),
    ("Registration", "register bind wire connect"), ("Configuration", "config option setting"), ("Migration", "migrat upgrade schema"), ("Lifecycle", "start stop restart"),
]

# Paths of tests, examples and command-line programs.
TEST_DIRS = r"(^|/)(_*test(s|ing|data|util|utils)?([_-]\w+)?_*|_*specs?_*|__tests__|__mocks__|__snapshots__|e2e|cypress|fixtures?|mocks?|mirage|androidtest)(/|$)"
TEST_NAMES = "testing.go test_helpers.go test_helper.go testutil.go testutils.go conftest.py test_helpers.rb test_helper.rb spec_helper.rb rails_helper.rb".split()
TEST_PARTS = ".test. .spec. .cy. uitests/ .tests/ tests/feature/ tests/unit/ src/test/".split()
TEST_ENDS = (
    "_test.go _test.py _spec.rb tests.swift test.swift tests.cs test.cs test.php test.java tests.java spec.java test.kt tests.kt spec.kt spec.scala suite.scala test.scala tests.scala "
    "_test.c _unittest.c _test.cpp _unittest.cpp _test.cc _unittest.cc _test.cxx _unittest.cxx"
).split()
EXAMPLE_DIRS = r"(^|/)(_*examples?([_-]\w+)?_*|_*demos?([_-]\w+)?_*|_*samples?([_-]\w+)?_*|_*tutorials?([_-]\w+)?_*|_*cookbooks?([_-]\w+)?_*|docs?([_-]\w+)?|storybook|stories|playgrounds?|sandbox(es)?|snippets?|quickstart|getting[_-]started|how[_-]?to|recipes?|showcase)(/|$)"
EXAMPLE_NAMES = r"(_example|^example_.*)\.(go|py|rs)$|_example\.rb$|(example|demo)\.(java|kt|scala|cs|swift)$|\.(example|stories)\.|^(example|demo|sample)\.[^.]*$"
COMMAND_DIRS = "cmd command commands cli".split()
UTILITY_DIRS = "/utils/ /util/ /helpers/ /helper/ /common/ /shared/ /lib/".split()
UTILITY_NAMES = r"^(utils|helpers|helper|util)$|_(utils|helpers)$"
GENERIC_DIRS = "structs internal util utils common helper helpers lib src pkg cmd app types models shared core base misc data root".split()

# Names and folders of documents.
DOC_NAMES = "readme architecture contributing design security code_of_conduct code-of-conduct install usage faq history migration upgrading development hacking quickstart tutorial overview api getting-started getting_started guide".split()
DOC_DIRS = "doc docs documentation wiki guides handbook manual book".split()
DOC_ENDS = "md rst txt adoc org".split()


def camel_split(c: Column) -> Column:
    """A space before a capital that follows a small letter or digit."""
    return F.regexp_replace(c, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " ")


def clean_words(c: Column) -> Column:
    """Lower-case words of a query without stop words, repeats included."""
    words = F.split(F.lower(camel_split(c)), r"[^\p{L}\p{Nd}_]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def flow_label(name: Column) -> Column:
    """Heuristic label of a flow; the first rule that matches."""
    low = F.lower(name)
    out = F.when((low == "main") | low.endswith(".main"), "Application entry point")
    for label, patterns in FLOW_LABELS:
        out = out.when(reduce(Column.__or__, [low.contains(p) for p in patterns.split()]), label)
    return out.otherwise("Execution flow")


def path_dir(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def path_base(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def is_test_path(path: Column) -> Column:
    """Whether a file belongs to tests; false for null."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = path_base(low)
    found = low.rlike(TEST_DIRS) | base.isin(*TEST_NAMES) | base.rlike(r"^test(_.*)?\.go$|^test_.*\.py$")
    for part in TEST_PARTS:
        found = found | low.contains(part)
    for end in TEST_ENDS:
        found = found | low.endswith(end)
    return F.coalesce(found, F.lit(False))


def is_usage_path(path: Column) -> Column:
    """Whether a file shows how others are used: tests, examples, documents."""
    return is_test_path(path) | is_example_path(path)


def is_example_path(path: Column) -> Column:
    """Whether a file is an example, a demonstration or a document; false for null."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(low.rlike(EXAMPLE_DIRS) | path_base(low).rlike(EXAMPLE_NAMES), F.lit(False))


def is_utility_path(path: Column) -> Column:
    """Whether a file holds helpers, by its folders or name; false for null."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = F.regexp_replace(path_base(low), r"\.[^.]*$", "")
    return F.coalesce(reduce(Column.__or__, [low.contains(d) for d in UTILITY_DIRS]) | stem.rlike(UTILITY_NAMES), F.lit(False))


def is_generic_dir(name: Column) -> Column:
    """Whether a folder's name says nothing of what is in it."""
    return F.coalesce(F.lower(name).isin(*GENERIC_DIRS), F.lit(False))


def is_document_path(path: Column) -> Column:
    """Whether a file is a document, by its name or by a folder and ending; false for null."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = path_base(low)
    names, ends = "|".join(DOC_NAMES), "|".join(DOC_ENDS)
    named = base.rlike(rf"^({names})$") | base.rlike(rf"^({names})([_-].*)?\.({ends})$")
    placed = base.rlike(rf"\.({ends})$") & low.rlike(rf"(^|/)({'|'.join(DOC_DIRS)})/")
    return F.coalesce(named | placed, F.lit(False))


def is_command_path(path: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, COMMAND_DIRS))), F.lit(False))


# Names of entry points, of helpers and, by language, of entry points; folders of frameworks.
ENTRY_NAMES = r"(?i)^(main|init|bootstrap|start|run|setup|configure)$|^handle|^on[A-Z]|Controller$|Handler$|^process[A-Z]|^execute|^perform|^dispatch|^trigger|^fire|^emit"
HELPER_NAMES = r"(?i)^get[A-Z]|^set[A-Z]|^is[A-Z]|^has[A-Z]|^can[A-Z]|^format|^parse|^validate|^toString|^fromJSON|^from[A-Z]|^encode|^decode|^serialize|^clone|^merge|^_"
LANGUAGE_ENTRIES = {
    "typescript": "^use[A-Z]", "javascript": "^use[A-Z]", "python": "^(get|post|put|delete|patch)_", "java": "^do(Get|Post|Put|Delete)|^service$", "go": "^New[A-Z]|^Handle|^Serve", "rust": "^handle_|^process_|^serve",
    "swift": "^viewDidLoad$|^viewWillAppear$|^body$|^applicationDidFinishLaunching", "php": "^(handle|index|store|show|update|destroy)$", "csharp": "^(Get|Post|Put|Delete|Patch)[A-Z]|^On[A-Z]|^Configure",
    "c": "_init$|^init_|_start$|^start_|_handler$|^handle_|_callback$|^cmd_|^server_|^client_|^session_|^window_|^signal_|^event_", "cpp": "^(Create|create)[A-Z_]|^(Run|run)$|^(Start|start)$|^On[A-Z]|^on_", "scala": "^apply$|^receive$|^props$|^routes?$",
}
FRAMEWORKS = [
    (r"(?i)(^|/)pages/", "framework:nextjs-page"), (r"(?i)(^|/)app/.*route\.(ts|js)x?$", "framework:nextjs-app-router"), (r"(?i)(^|/)routes/", "framework:route-handler"), (r"(?i)(^|/)controllers/", "framework:controller"),
    (r"(?i)(^|/)handlers/", "framework:handler"), (r"(?i)(^|/)api/", "framework:api-handler"), (r"(?i)(^|/)middleware/", "framework:middleware"),
]


def entry_score(name: Column, language: Column, exported: Column, callers: Column, callees: Column, path: Column) -> Column:
    """How likely a symbol is an entry point: a struct of score and reasons.

    Callees over callers plus one, times what name, visibility and folder say;
    0 for a symbol that calls nothing. Nulls count as nothing known.
    """
    entry = F.coalesce(name, F.lit("")).rlike(ENTRY_NAMES)
    for lang, pattern in LANGUAGE_ENTRIES.items():
        entry = entry | (F.coalesce(language, F.lit("")) == lang) & F.coalesce(name, F.lit("")).rlike(pattern)
    helper = ~entry & F.coalesce(name, F.lit("")).rlike(HELPER_NAMES)
    place = F.lit(None).cast("string")
    for pattern, reason in reversed(FRAMEWORKS):
        place = F.when(F.replace(path, F.lit("\\"), F.lit("/")).rlike(pattern), reason).otherwise(place)
    seen = F.coalesce(exported, F.lit(False))
    factor = F.when(seen, 2.0).otherwise(1.0) * F.when(entry, 1.5).when(helper, 0.3).otherwise(1.0) * F.when(place.isNotNull(), 1.5).otherwise(1.0)
    n = F.coalesce(callees, F.lit(0))
    reasons = F.array_compact(F.array(F.when(seen, "exported"), F.when(entry, "entry-pattern").when(helper, "utility-pattern"), place))
    return F.when(n == 0, F.struct(F.lit(0.0).alias("score"), F.array(F.lit("no-outgoing-calls")).alias("reasons"))).otherwise(F.struct((n / (F.coalesce(callers, F.lit(0)) + 1) * factor).alias("score"), reasons.alias("reasons")))


def is_prose(query: str) -> bool:
    """Whether a query is a sentence rather than a name or two.

    More than one word, of which two fifths or more are stop words or which are
    four or more.
    """
    raw = query.lower().split()
    kept = [w for w in re.split(r"[^\w]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", query).lower()) if w and w not in STOP_WORDS]
    return len(raw) > 1 and (len(raw) >= 4 or bool(kept) and 1 - len(kept) / len(raw) >= 0.4)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def token_estimate(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4)
