"""The pipeline against plain versions of its stages."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
from test_decontaminate import words
from test_line_dedup import sequence
from test_ngram_join import WORD
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.quality_rules import verdicts
from millrace.llm.queries import QUERIES


def windows(items):
    """Windows of the items by their length in words."""
    out = {}
    for w in (words(t) for _, t in items):
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            out.setdefault(n, set()).add(tuple(w[i : i + n]))
    return out


def holds_window(text, known):
    w = words(text)
    return any(tuple(w[i : i + n]) in found for n, found in known.items() for i in range(len(w) - n + 1))


def without_blocks(rows, least=30):
    """Texts without blocks of lines, of so many words, that any earlier document has."""
    places, out = defaultdict(list), []
    for i, text in sorted(rows):
        own, gone = sequence(text), set()
        for x, line in enumerate(own):
            for earlier, y in places[line["h"]]:
                if x and y and own[x - 1]["h"] == earlier[y - 1]["h"]:
                    continue  # inside a block that begins before
                k = 0
                while x + k < len(own) and y + k < len(earlier) and own[x + k]["h"] == earlier[y + k]["h"]:
                    k += 1
                if sum(z["words"] for z in own[x : x + k]) >= least:
                    gone.update(z["place"] for z in own[x : x + k])
        for y, line in enumerate(own):
            places[line["h"]].append((own, y))
        if gone:
            text = "\n".join(z for k, z in enumerate(text.split("\n")) if k not in gone)
            text = text if text.strip() else ""
        if text or not gone:
            out.append((i, text))
    return out


def components(rows, n=5, percent=80):
    """The smallest id that each row's links lead to, by shingles of n words."""
    made = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        made.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    holders, top = defaultdict(list), list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, own in enumerate(made):
        shared = Counter(j for s in own for j in holders[s])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(made[j]) - both):
                top[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram join", "decontamination", "byte-pair encoding",
    ]


def test_same_as_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in verdicts(docs).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in kept)
    rows = without_blocks(rows)
    led = components(rows)
    rows = [(i, t) for i, t in rows if led[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = windows(items)
    rows = [(i, t) for i, t in rows if not holds_window(t, known)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        ids = " ".join(map(str, e.ids))
        decoded = library.decode(e.ids, skip_special_tokens=False)
        want[i] = len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    got = QUERIES["pipeline"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert len(got) == len(want)


def test_columns_and_odd_rows(spark, tmp_path):
    text = " ".join(f"w{i} and some more words" for i in range(20))
    rows = [(1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 1), (2, None, None, None, None, 2), (None, text, "en", "s", 7, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Gone int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.createDataFrame([], "item_id long, text string")
    none.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("1 = 0"), str(tmp_path)).collect() == []
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    n = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", n), ("1", n), ("None", n)]
