"""Updates of a stored corpus give what a full build gives, and touch only what has changed."""

import os
import tempfile

import pytest

from murmur.operators import corpus
from murmur.plans.incremental import IncrementalCorpus

WORDS = ["network", "server", "malware", "password", "browser", "cloud", "packet", "kernel"]
# the three stopwords stay ahead, so that small changes don't move them
TEXTS = [f"The attack and the hacker with the system, {WORDS[i % 8]} of the {WORDS[i * 3 % 7]} attack hacker system attack hacker attack"
         for i in range(40)]
ROWS = [(i, t, "v") for i, t in enumerate(TEXTS)] + [(100, None, "v"), (101, "", "v"), (None, TEXTS[0], "w"), (3, TEXTS[5], "v"), (7, TEXTS[7], "v")]
SCHEMA = "comment_id long, text string, video_id string"
COLUMNS = ["comment_id", "text", "video_id", "lemmas", "final_tokens", "final_text"]


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(folder) for f in names if f.startswith("part-") and "bucket=" in d}


def _check(spark, store, rows):
    """The store's tables against the build of all rows at once."""
    final, freq, _ = corpus.preprocess(spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA), top_n=3)
    want = sorted(map(repr, final.select(*COLUMNS).collect()))
    assert sorted(map(repr, store.final.select(*COLUMNS).collect())) == want
    assert {tuple(r) for r in store.word_frequency().collect()} == {tuple(r) for r in freq.collect()}
    assert store.processed.count() == len(want)
    return len(want)


@pytest.fixture
def store(spark):
    return IncrementalCorpus(spark, tempfile.mkdtemp(prefix="murmur-inc-"), buckets=8, top_n=3)


def _update(spark, store, rows, monkeypatch):
    made = []
    prepare = corpus.prepare
    with monkeypatch.context() as m:
        m.setattr(corpus, "prepare", lambda df: made.append(df.count()) or prepare(df))
        changed = store.update(spark.createDataFrame(rows, SCHEMA))
    return changed, sum(made)


def test_added_changed_and_removed_rows(spark, store, monkeypatch):
    changed, made = _update(spark, store, ROWS, monkeypatch)
    assert len(changed) == 8 and made == len(ROWS) - 1             # (7, ...) is there twice
    assert _check(spark, store, ROWS) >= 40

    before = _files(store.folder)
    assert _update(spark, store, ROWS[::-1], monkeypatch) == ([], 0) and _files(store.folder) == before

    more = ROWS + [(500, "The malware of the server, attack", "v"), (500, "The kernel of the cloud, hacker", "v")]
    changed, made = _update(spark, store, more, monkeypatch)
    assert len(changed) == 1 and made == 2
    after = _files(store.folder)
    touched = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert touched and all(f"bucket={changed[0]}/" in f for f in touched)
    _check(spark, store, more)

    other = [(i, (t + " password") if i == 11 else t, v) for i, t, v in more if i != 12]
    changed, made = _update(spark, store, other, monkeypatch)
    assert 1 <= len(changed) <= 2 and made == 1
    _check(spark, store, other)


def test_other_stopwords_and_emptied_buckets(spark, store, monkeypatch):
    _update(spark, store, ROWS, monkeypatch)
    few = [(i, "The browser of the kernel and the browser, the cloud", "v") for i in (1, 2)]
    _, made = _update(spark, store, few, monkeypatch)
    assert made == 2
    _check(spark, store, few)
    assert _update(spark, store, [], monkeypatch)[1] == 0
    assert store.final.count() == 0 and store.word_frequency().count() == 0
    _update(spark, store, few, monkeypatch)
    _check(spark, store, few)


@pytest.mark.parametrize("fails", ["processed", "seen", "final"])
def test_an_update_that_failed_is_made_good(spark, store, monkeypatch, fails):
    _update(spark, store, ROWS[:30], monkeypatch)
    put = IncrementalCorpus._put

    def failing(self, rows, name, changed):
        out = put(self, rows, name, changed)
        if name == fails:
            raise RuntimeError("lost")
        return out
    with monkeypatch.context() as m:
        m.setattr(IncrementalCorpus, "_put", failing)
        with pytest.raises(RuntimeError):
            store.update(spark.createDataFrame(ROWS, SCHEMA))
    _update(spark, store, ROWS, monkeypatch)
    _check(spark, store, ROWS)
