"""Languages of documents and of the segments of mixed ones.

The script of a word narrows the candidate languages; among those every word has scores from a character n-gram model
with whole words, and Viterbi decoding with a penalty for switching labels the words of a document, with a lower penalty
between sentences. Only whole sentences of prose are read. The model is fitted on a bounded sample of labelled documents
and refined once on its own labels, which takes out wrong ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_rows, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "ja")
LATIN = ("en", "de", "fr", "es", "pt", "nl")
#: Labelled documents that the model is fitted on, at most for each language, and characters of one of them.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Log odds that a change of language costs inside a sentence and between two.
SWITCH, SWITCH_SENTENCE = 9.0, 2.5
#: What one language may miss over a sentence that is decoded as a whole.
SINGLE = SWITCH - 2 * SWITCH_SENTENCE
#: Share of the words that a language knows below which a text of so many words or more is of none of them.
LEAST_KNOWN, KNOWN_WORDS = 0.2, 6
#: The language of what is none of ``LANGUAGES``.
OTHER = "other"
#: Words (or characters of Japanese) that a sentence has at least.
LEAST_WORDS, LEAST_KANA = 4, 8
#: Sentences that make a further language count.
LEAST_SENTENCES = 2

# Usual names and codes of the languages.
NAMES = {
    "en": "en eng english englisch anglais inglés inglês engels английский 英語",
    "de": "de deu ger german deutsch allemand alemán alemão duits немецкий ドイツ語",
    "fr": "fr fra fre french français francais französisch francés francês frans французский フランス語",
    "es": "es spa spanish español espanol castellano castilian spanisch espagnol espanhol spaans испанский スペイン語",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portugees португальский ポルトガル語",
    "nl": "nl nld dut dutch nederlands flemish vlaams niederländisch néerlandais neerlandés holandês голландский нидерландский オランダ語",
    "ru": "ru rus russian русский russisch russe ruso russo ロシア語",
    "ja": "ja jpn japanese 日本語 jp japanisch japonais japonés japonês japans японский",
}
# Common words, the start of the model where the sample says little.
COMMON = {
    "en": "the of and to in is that it for was on are as with be this by not have from or an they which we there their has will would been when who no more if out so what up its about than into them only other could can some",
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für im dem des auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man wenn",
    "fr": "le la les de des et est un une du que pas dans qui il pour ce au sur ne se plus par avec sont être cette aux ou mais nous vous ont leur elle si été tout fait même ces entre sans peut dont où très",
    "es": "el la los de que y en un una se del las por con no para su es lo como más al pero sus le ha este si porque esta son entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante",
    "pt": "o a os as de que e do da em um uma para com não no na se por mais dos das como mas ao ele seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos são está",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om hij maar dan ook als bij nog uit naar door over ze zich wordt of deze worden wat kan werd hebben geen meer al was je dit tot heeft",
}

_ALIASES = {a: lang for lang, names in NAMES.items() for a in names.split()}
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n(?:[\s\S]*?^[ \t]*\1[ \t]*$|[\s\S]*\Z)", re.MULTILINE)
_CODE = re.compile(r"`[^`\n]*`")
_DROP = re.compile(r"</?[a-zA-Z][^<>\n]*>|!?\[([^\]\n]*)\]\([^)\n]*\)|https?://\S+|&\w+;|\b[\w.+-]+@[\w-]+\.[\w.]+|:\w+:")
_LEAD = re.compile(r"^(?:\s|>|[-*+•](?=\s)|\d+[.)](?=\s)|\[[ xX]\]|#+(?=\s)|\|)*(?:\w+(?:\([\w ,./-]*\))?!?:\s+)?")
_PREFIX = re.compile(r"^(?:feat|fix|docs?|chore|refactor|test|style|perf|build|ci|revert)(?:\([^)]*\))?!?:\s+")
_BULLET = re.compile(r"^(?:\s|>|[-*+•](?=\s)|\d+[.)](?=\s)|\[[ xX]\](?=\s)|\|)+")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$|[^\x00-⿿])|[。！？]+[」』）]*")
_NOT_PROSE = re.compile(
    r"\s*(?:at\s+\S+\s*\(|File \"|Traceback|\d{4}-\d\d-\d\d[T ]\d|\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b|(?:[A-Z]\w*)?(?:Error|Exception)\b\s*:|[$>]\s+\w+\s*$|#!"
    r"|//|/\*|\*/|@\w+|#include|import\s+[\w{\"']|from\s+[\w.]+\s+import|def\s+\w+\(|class\s+\w+[:({]|func\s|fn\s|return\s+[\w.]+\(|package\s+\w+\s*;?$|[-=|:\s*_+]+$)|.*[{};]\s*$"
)
_CODE_BITS = re.compile(r"=>|->|::|:=|==|!=|\+=|&&|\|\||\w\(\w*\)\s*;")
_IDENT = re.compile(r"\w*(?:\d|_|[a-zß-ÿ][A-Z])\w*|\w+(?:[./\\:]+\w+)+|\S*[/\\@#{}<>=\[\]|~^]\S*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_KANA = re.compile("[぀-ヿ㐀-鿿ｦ-ﾝ々〆]+")
_HIRAGANA = re.compile("[぀-ヿｦ-ﾝ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_FOREIGN = re.compile("[^\x00-\u024fЀ-ӿ぀-ヿ㐀-鿿ｦ-ﾝ々〆\u2000-\u2bff\u1e00-\u1eff]")
_EMOJI = re.compile("[☀-➿\U0001f000-\U0001ffff️‍]+")


#: What an identifier has somewhere.
_SUSPECT = re.compile(r"[\d_/\\@#{}<>=\[\]|~^]|[a-zß-ÿ][A-Z]|\w[./\\:]+\w")
_LINE = re.compile(r"[^\s][^\n]*[^\s]|[^\s]")
_UNSEEN = re.compile("[\u200b\u200c\u2060\ufeff\u00ad\r\u2028\u2029\x85]")
#: Marks without width, and other ends of lines, as blanks of the same length.
_INVISIBLE = {0x200B: " ", 0x200C: " ", 0x2060: " ", 0xFEFF: " ", 0xAD: " ", 0x0D: " ", 0x2028: "\n", 0x2029: "\n", 0x85: "\n"}


def _composed(s: str) -> str:
    return s if s.isascii() or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)


def label_language(label: str | None) -> str | None:
    """The language that a label names, in whatever spelling; None if it names none of those known here."""
    if label is None:
        return None
    t = unicodedata.normalize("NFC", label).strip().lower()
    return _ALIASES.get(t) or _ALIASES.get(re.split(r"[-_ (.@]", t, maxsplit=1)[0])


def _without_fences(text: str) -> str:
    """The text with fenced code and marks without width as blanks, of the same length."""
    plain = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if "```" in text or "~~~" in text else text
    return plain.translate(_INVISIBLE) if _UNSEEN.search(plain) else plain


def _words(part: str) -> list[str]:
    """The words of a part of a text without identifiers, paths and the like."""
    part = _composed(part.replace("\x00", " "))
    if _SUSPECT.search(part):
        part = " ".join([_IDENT.sub(" ", x) if _SUSPECT.search(x) else x for x in part.split()])
    return _WORD.findall(part)


def rest(text: str, whole: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, list[str]]]:
    """What stands between the whole sentences of a text, line by line: start and end in the text, and words."""
    plain, out = _without_fences(text), []
    stops = [0, *[b for _, b, _ in whole]]
    for a, b in zip(stops, [*[a for a, _, _ in whole], len(plain)], strict=True):
        for m in _LINE.finditer(plain, a, b):
            part = _DROP.sub(lambda x: " " * len(x[0]), _CODE.sub(lambda x: " " * len(x[0]), m[0]))
            words = _words(part) or _KANA.findall(part)
            if words:
                out.append((m.start(), m.end(), words))
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Whole sentences of prose: start and end in the text, and words; code, identifiers, logs and greetings don't count."""
    blank = lambda m: " " * len(m[0])
    plain = _without_fences(text)
    out = []
    at = 0
    for line in plain.split("\n"):
        begin, at = at, at + len(line) + 1
        if len(line) < 8 or line.isspace():
            continue
        # a code span stands for a word; its place keeps sentence ends apart
        clean = _CODE.sub(lambda m: "\x00" * len(m[0]), line)
        clean = _EMOJI.sub(blank, _DROP.sub(blank, clean)) if not clean.isascii() or any(c in clean for c in "<[@&:") else clean
        if _NOT_PROSE.match(clean):
            continue
        if m := _BULLET.match(clean):
            clean = " " * m.end() + clean[m.end() :]
        stripped = clean.lstrip()
        if stripped.startswith("#"):
            continue
        if m := _PREFIX.match(stripped):
            lead = len(clean) - len(stripped) + m.end()
            clean = " " * lead + clean[lead:]
        pos = 0
        for m in _END.finditer(clean):
            part = clean[pos : m.end()]
            start, pos = pos, m.end()
            if _CODE_BITS.search(part):
                continue
            kana = 0 if part.isascii() else sum(map(len, _KANA.findall(part)))
            words = _words(part)
            if kana >= LEAST_KANA:
                words = _KANA.findall(part)
            elif len(words) < LEAST_WORDS:
                continue
            lead = len(part) - len(part.lstrip())
            out.append((begin + start + lead, begin + m.end(), words))
    return out


def script(word: str) -> tuple[str, ...]:
    """The languages that write with the script of the word."""
    if word.isascii():
        return LATIN
    if _KANA.search(word):
        return ("ja",)
    if _CYRILLIC.search(word):
        return ("ru",)
    return LATIN


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


class Model:
    """Scores of words in the Latin languages; the other languages are told by script."""

    def __init__(self, words: dict[str, Counter], grams: dict[str, Counter]) -> None:
        self.words, self.grams = words, grams
        self.word_total = {x: sum(words[x].values()) for x in LATIN}
        self.gram_total = {x: sum(grams[x].values()) for x in LATIN}
        self.cache: dict[str, tuple[float, ...]] = {}
        self.emissions: dict[str, tuple[float, ...]] = {}

    @classmethod
    def fit(cls, counts: dict[str, Counter]) -> Model:
        words: dict[str, Counter] = {x: Counter() for x in LATIN}
        for x in LATIN:
            words[x].update(dict.fromkeys(COMMON[x].split(), 20))
            words[x].update(counts.get(x, {}))
        grams: dict[str, Counter] = {x: Counter() for x in LATIN}
        for x in LATIN:
            g = grams[x]
            for w, n in words[x].items():
                weight = math.sqrt(n)
                for gram in _grams(w):
                    g[gram] += weight
        return cls(words, grams)

    def scores(self, word: str) -> tuple[float, ...]:
        """Log probability of the word in each Latin language, relative to the best, bounded."""
        w = word.lower()
        found = self.cache.get(w)
        if found is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            raw = []
            grams = _grams(w)
            for x in LATIN:
                seen, total = self.words[x].get(w, 0), self.word_total[x]
                p_word = (seen + 1e-4 * total / (1 + total)) / (total + 1) if seen else 0.0
                g, size = self.grams[x], self.gram_total[x]
                shape = sum(math.log((g.get(k, 0.0) + 0.3) / (size + 3000)) for k in grams) / max(1, len(grams)) ** 0.5 * 0.6
                raw.append((math.log(p_word + 1e-6), shape))
            best_w, best_s = max(r[0] for r in raw), max(r[1] for r in raw)
            mixed = [0.7 * (a - best_w) + 0.3 * (b - best_s) for a, b in raw]
            top = max(mixed)
            found = self.cache[w] = tuple(max(-6.0, m - top) for m in mixed)
        return found

    def emission(self, word: str) -> tuple[float, ...]:
        """Scores of the word in all languages: those its script rules out are far behind."""
        found = self.emissions.get(word)
        if found is None:
            if len(self.emissions) > 500_000:
                self.emissions.clear()
            langs = script(word)
            latin = self.scores(word) if langs is LATIN else (-8.0,) * len(LATIN)
            found = (*latin, 0.0 if langs == ("ru",) else -8.0, 0.0 if langs == ("ja",) else -8.0)
            self.emissions[word] = found
        return found

    def label(self, parts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and confidence of each sentence of a document: Viterbi over all its words.

        The best score of a word is 0. Where one language misses at most ``SINGLE`` over a whole sentence, no switch inside
        it can pay: it would cost ``SWITCH``, and going there and back between sentences costs no more than the rest. Such a
        sentence is one step of the decoding, any other one step for each word.
        """
        emit = self.emission
        score: list[float] | None = None
        steps: list[tuple[list[float], float, int]] = []  # scores before a step, those of a switch, the sentence
        totals = []
        for k, words in enumerate(parts):
            emissions = [emit(w) for w in words]
            sums = list(map(sum, zip(*emissions)))  # noqa: B905
            totals.append((sums, len(words)))
            cost = SWITCH_SENTENCE
            for s in [sums] if max(sums) >= -SINGLE else emissions:
                if score is None:
                    score = list(s)
                    steps.append((score, -math.inf, k))
                else:
                    jump = max(score) - cost
                    steps.append((score, jump, k))
                    score = [(a if a >= jump else jump) + b for a, b in zip(score, s)]  # noqa: B905
                cost = SWITCH
        if score is None:
            return [("", 0.0) for _ in parts]
        at = score.index(max(score))
        votes: list[list[int]] = [[] for _ in parts]
        for before, jump, k in reversed(steps):
            votes[k].append(at)
            if before[at] < jump:
                at = before.index(max(before))
        out = []
        for v, (sums, n) in zip(votes, totals, strict=True):
            best = v[0] if v.count(v[0]) == len(v) else max(set(v), key=lambda i: (v.count(i), -i))
            scale = max(1.0, n**0.5)
            # how sure the words of the sentence alone make its language, from 0 to 1
            out.append((LANGUAGES[best], round(1.0 / sum([math.exp(min(50.0, (x - sums[best]) / scale)) for x in sums]), 4)))
        return out

    def known(self, words: list[str], lang: str) -> float:
        """The share of the words that are those of a language: by script, or by having been seen in it."""
        if lang not in LATIN:
            fit = _CYRILLIC if lang == "ru" else _KANA
            return sum([bool(fit.search(w)) for w in words]) / len(words)
        seen = self.words[lang]
        return sum([w.lower() in seen for w in words]) / len(words)


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """Language and text of at most ``SAMPLE`` documents for each language label, chosen by a hash of their id.

    Labels are counted first, so that only about three times the sample has to be ordered.
    """
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([^-_ (.@]+)", 1))
    known = F.create_map(*[F.lit(x) for a, lang in _ALIASES.items() for x in (a, lang)])
    ids = documents.select("doc_id", F.element_at(known, code).alias("label"), F.xxhash64("doc_id").alias("h")).where(F.col("label").isin(*LATIN))
    counts = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}  # a row for each language
    if not counts:
        return []
    near = None
    for x, n in counts.items():
        # hashes are spread evenly over the 64-bit numbers
        most = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 3 * SAMPLE / n)))
        part = (F.col("label") == x) & (F.col("h") <= F.lit(most))
        near = part if near is None else near | part
    place = F.row_number().over(W.partitionBy("label").orderBy("h", "doc_id"))
    chosen = ids.where(near).withColumn("place", place).where(F.col("place") <= SAMPLE).select("doc_id", "label")
    texts = documents.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()  # SAMPLE ids for each of six languages at most
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]


def fit(labelled: list[tuple[str, str]], rounds: int = 1) -> Model:
    """A model from labelled texts, refined on the labels that it gives to their sentences itself."""
    parts = [(label, [w for _, _, w in sentences(text)]) for label, text in labelled]
    counts: dict[str, Counter] = defaultdict(Counter)
    for label, found in parts:
        for words in found:
            counts[label].update(w.lower() for w in words if script(w) == LATIN)
    model = Model.fit(counts)
    for _ in range(rounds):
        counts = defaultdict(Counter)
        for _, found in parts:
            for words, (lang, sure) in zip(found, model.label(found), strict=True):
                if sure > 0.5:
                    counts[lang].update(w.lower() for w in words if script(w) == LATIN)
        model = Model.fit(counts)
    return model


SEGMENTS = "doc_id bigint, label string, segment int, start int, stop int, lang string, sentences int, confidence double"


def _segmenter(shared, whole: bool):
    def make():
        words, grams = shared.value
        model = Model(words, grams)

        def labelled(text: str) -> list[tuple[int, int, str, float]]:
            found = sentences(text)
            if whole:
                labels = model.label([w for _, _, w in found])
                return [(a, b, lang, sure) for (a, b, _), (lang, sure) in zip(found, labels, strict=True)]
            found = sorted(found + rest(text, found))
            kana, out = _HIRAGANA.search(text) is not None, []
            for (a, b, w), (lang, sure) in zip(found, model.label([w for _, _, w in found]), strict=True):
                share = model.known(w, lang)
                if len(w) >= KNOWN_WORDS and share < LEAST_KNOWN or share == 0 and any(_FOREIGN.search(x) for x in w) or lang == "ja" and not kana:
                    lang, sure = OTHER, round(1 - share, 4) if lang != "ja" else 0.5
                out.append((a, b, lang, sure))
            return out

        def rows(doc_id, lang, text):
            out: list[list] = []
            for a, b, name, sure in labelled(text) if text else []:
                if out and out[-1][5] == name:
                    out[-1][4], out[-1][6], out[-1][7] = b, out[-1][6] + 1, out[-1][7] + sure
                else:
                    out.append([doc_id, label_language(lang), len(out), a, b, name, 1, sure])
            return [(*x[:7], round(x[7] / x[6], 4)) for x in out]

        return rows

    return make


def segments(documents: DataFrame, whole: bool = True) -> DataFrame:
    """One row per run of sentences of one language: place in the text, language, sentences, mean confidence.

    With ``whole`` only whole sentences of prose are read; without it what stands between them is too, line by line, so that
    every document with a word has a language. That is ``other`` where the best one knows hardly any of the words, and for
    Chinese characters in a text without kana. ``label`` is the language that the document's label names, null if it names
    none. Texts without a word, null, empty and blank ones give no rows. Only doc_id, lang and text are read.
    """
    model = fit(sample(documents))
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.grams))
    return map_rows(spread(documents.select("doc_id", "lang", "text")), _segmenter(shared, whole), SEGMENTS)


def document_languages(found: DataFrame) -> DataFrame:
    """Languages of each document with sentences and confidence; ``main`` marks the one with the most sentences.

    Of languages with equally many sentences the one with the longer text is the main one, then the first by name.
    """
    by = found.groupBy("doc_id", "label", "lang").agg(
        F.sum("sentences").cast("int").alias("sentences"),
        F.round(F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences"), 4).alias("confidence"),
        F.sum(F.col("stop") - F.col("start")).alias("chars"),
    )
    # a document has no more rows here than there are languages
    each = F.struct("sentences", "chars", F.negative(F.ascii("lang")).alias("first"), "lang", "confidence")
    docs = by.groupBy("doc_id", "label").agg(F.collect_list(each).alias("all"))
    main = docs.withColumn("top", F.array_max("all")).select("doc_id", "label", "top", F.explode("all").alias("l"))
    return main.select("doc_id", "label", "l.lang", "l.sentences", "l.confidence", (F.col("l.lang") == F.col("top.lang")).alias("main"))


def wrong_labels(languages: DataFrame) -> DataFrame:
    """Languages of the documents whose label is missing or wrong, or that hold a further language."""
    counted = F.col("main") | (F.col("sentences") >= LEAST_SENTENCES)
    per = languages.groupBy("doc_id").agg(
        F.bool_or(F.col("main") & ~F.col("label").eqNullSafe(F.col("lang"))).alias("wrong"),
        F.count_if(counted).alias("n"),
        F.collect_list(F.when(counted, F.col("lang"))).alias("langs"),
    )
    return per.where("wrong or n > 1").select("doc_id", F.explode("langs").alias("lang"))
