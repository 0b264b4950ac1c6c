"""Broken prompt and response pairs.

Each response is unwrapped (thinking, fences, JSON actions) and tried in turn:
without content it is empty; a phrase of the refusal dictionary without any
result is a refusal; a copy is a response that costs next to nothing when
compressed with the prompt as zstandard dictionary, and the other way round;
function-word dictionaries tell the language of both sides; an open structure or
statement is truncated. What ends without a final mark is held against a
terminal-context model: the last words with which sentences of all responses
end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import broadcast_if_small, load, materialise, spread

#: Words of a terminal context; marks behind them that do not count.
CONTEXT_WORDS = 3
TRAILING = r"[\"'”’»)\]*_`\s]+$"

#: Function words by language, from the stop-word lists of the Snowball stemmer project.
FUNCTION_WORDS = {
    "en": "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had having do does did doing would should could a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very",
    "de": "aber alle als also am an ander andere anderen auch auf aus bei bin bis bist da damit dann das daß dass dein dem den der des dessen dich die dies diese dieser dieses dir doch dort du durch ein eine einem einen einer eines einig einige er es etwas euch euer für gegen hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen ihr ihre im in indem ins ist jede jedem jeden jeder jedes jene jetzt kann kein keine können könnte machen man manche mein mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine selbst sich sie sind so solche soll sollte sondern sonst um und uns unter viel vom von vor war waren was weg weil weiter welche wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen über",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o fue este ha sí porque esta son entre está cuando muy sin sobre ser tiene también me hasta hay donde han quien están desde todo nos durante todos uno les ni contra otros ese eso había ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros era eran fueron es",
}
_WORDS = {
    "en": "the of and to in is are was were be been it its this that these those with for from on at by as not no an or but which what how there their has have had does did so if then than into after before between one only all each here where when while about because out up same keeps rows column table",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren wird werden wurde wurden hat haben mit für von vom zu zum zur im in am an auf aus bei nach über unter vor es sie er wir ich sich auch nur noch so wie was wenn weil dass zwar dort dieser diese dieses lässt erscheinen spalte zeilen",
    "es": "el la los las un una unos unas y o pero no es son era eran fue fueron ser hay de del al en con por para sin sobre que qué se su sus lo le les como más muy ya si cuando donde este esta estos estas tras entre desde hasta también porque columna filas aparece",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}

#: Phrases that decline, lower case.
REFUSALS = (
    r"\b(?:can ?not|can't|could not|couldn't|unable to|not able to|not going to|won't|will not|must not|may not|not allowed to|not permitted to) (?:be able to )?(?:help|assist|answer|provide|comply|fulfil|fulfill|do (?:this|that|so)|share|discuss|disclose|respond|support|complete this|continue with|process (?:this|that) request|give (?:any |this |that |an )?(?:information|answer|advice))",
    r"\b(?:something|anything|nothing) i (?:won't|will not|can't|cannot) do\b|\bdon't feel comfortable\b|\bnot comfortable\b|\b(?:must|have to|i|i'll|will) (?:respectfully |politely )?(?:decline|refuse)\b|\bno answer will be given\b|\b(?:is|goes) against (?:my|the|our) (?:policy|policies|rules|guidelines)\b|\bi(?:'d| would) rather not\b|\bnot possible for me to\b|\b(?:would not|wouldn't) be appropriate\b|\b(?:outside|beyond) (?:of )?what i(?:'m| am) (?:permitted|allowed|able)\b|\bas an? (?:ai|assistant|language model)\b",
    r"kann ich (?:dir |ihnen |euch |leider |dabei |hier |damit )*nicht (?:helfen|beantworten|weiterhelfen|dienen|unterstützen)|keine auskunft|(?:darf|kann|möchte|werde) ich (?:dazu |hierzu |darauf |das |diese (?:frage|anfrage|aufgabe) |leider |als assistent )*(?:nichts|nicht|keine) ?(?:sagen|antworten|beantworten|bearbeiten|ausführen|geben|auskunft|angaben|informationen)|nicht beantworten|muss ich ablehnen|lehne ich ab|bin nicht befugt|ist mir nicht (?:erlaubt|gestattet)",
    r"no puedo (?:ayudar|responder|contestar|proporcionar|dar|hacer eso|atender|asistir|compartir|facilitar)|no me está permitido|no se me permite|no estoy autorizad|prefiero no (?:contestar|responder|hacer)|debo (?:negarme|rechazar|declinar)|no (?:podré|podría|voy a) (?:ayudar|responder|contestar)|no es posible (?:responder|contestar|atender)|me niego",
    r"(?:不能|无法|不便|不可以|没办法|拒绝|恕难|不方便)(?:回答|提供|协助|帮助|帮忙|处理|满足|回应|执行|透露|从命)|不允许我|恕我",
)
_REFUSAL = re.compile("|".join(REFUSALS), re.I)

_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_THINK = re.compile(r"<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", re.S | re.I)
_FENCE = re.compile(r"```[ \t]*([\w+-]*)[ \t]*\n?(.*?)(```|\Z)", re.S)
_NOTHING = frozenset(("", "null", "none", "n/a", "na", "nan", "-", "--", "{}", "[]", '""', "''", "...", "…", "undefined", "empty", "无", "nil"))
_FINAL = re.compile(r"[.!?。！？](?:[\"'”’»)\]*_`]*)$")
_SQL_START = re.compile(r"^\s*(?:select\b|with\s+\w+\s+as\s*\(|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:table|view)\b|pragma\s|explain\s+(?:query\s+plan\s+)?select\b)", re.I)
_SHORT = re.compile(r"^[-*•]?\s*(?:[\w.%\"'-]+(?:\s[\w.%-]+)?\s*(?:[:=：]|==)\s*)?[\"']?[-+]?[\w.,%/-]*\d[\w.,%/:-]*[\"']?$")


class Unwrapped:
    """What a response says: prose, SQL, and whether its structure was left open."""

    def __init__(self, raw: str):
        self.prose: list[str] = []
        self.sql: list[str] = []
        self.open = False
        text = _INVISIBLE.sub("", raw)
        if re.search(r"<think(?:ing)?>", text, re.I) and not re.search(r"</think(?:ing)?>", text, re.I):
            self.open = True
        self._text(_THINK.sub(" ", text))

    def _text(self, text: str) -> None:
        at = 0
        for m in _FENCE.finditer(text):
            self._plain(text[at : m.start()])
            at = m.end()
            self.open |= not m[3]
            if m[1].lower() in ("sql", "sqlite") or _SQL_START.match(m[2]):
                self._sql(m[2])
            else:
                self._plain(m[2])
        self._plain(text[at:])

    def _sql(self, text: str) -> None:
        text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip()
        if text:
            self.sql.append(text)

    def _plain(self, text: str) -> None:
        text = text.strip()
        if text[:1] in ("{", "["):
            try:
                self._leaves(json.loads(text, strict=False), None)
                return
            except ValueError:
                if self._cut_json(text):
                    self.open = True
                    for m in re.finditer(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"?', text):
                        if m[1] != "action":
                            self._leaves(m[2], m[1])
                    return
        if _SQL_START.match(text) and re.search(r"\bfrom\b|\bselect\b", text, re.I) and re.match(r"^\s*(?:SELECT|WITH)\b", text):
            self._sql(text)
        elif text.strip("`*_ \n\t\"'“”").lower() not in _NOTHING:
            self.prose.append(text)

    def _leaves(self, x: object, key: str | None) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k not in ("action", "tool", "name") or isinstance(v, dict | list):
                    self._leaves(v, k)
        elif isinstance(x, list):
            for v in x:
                self._leaves(v, key)
        elif isinstance(x, str):
            if key in ("sql", "query"):
                self._sql(x)
            else:
                self._text(x)
        elif x is not None and not isinstance(x, bool):
            self.prose.append(str(x))

    @staticmethod
    def _cut_json(text: str) -> bool:
        """True where a JSON text ends inside a string or a bracket."""
        depth, inside, skip = 0, False, False
        for ch in text:
            if skip:
                skip = False
            elif inside:
                skip, inside = ch == "\\", ch != '"'
            elif ch == '"':
                inside = True
            elif ch in "{[":
                depth += 1
            elif ch in "}]":
                depth -= 1
        return inside or depth > 0


def sql_open(sql: str) -> bool:
    """True where a statement breaks off: open brackets or quotes, or a last clause that lacks its operand."""
    text = re.sub(r"'[^']*'", "'x'", sql.strip().rstrip(";").strip())
    if text.count("(") > text.count(")") or text.count("'") % 2 or text.count('"') % 2:
        return True
    if re.search(r"(?:[,(.=<>+*/|-]|\b(?:select|distinct|from|join|inner|left|right|outer|on|where|and|or|not|group|order|by|as|in|like|between|having|limit|case|when|then|else|union|with))$", text, re.I):
        return not re.search(r"\bcount\s*\(\s*\*$|\*$", text)
    if not re.search(r"\bfrom\b", text, re.I):
        return bool(re.match(r"select\b", text, re.I)) and not re.match(r"select\s+[\d']", text, re.I)
    last = re.split(r"\b(from|join|on|where|and|or|having)\b", text, flags=re.I)
    word, rest = last[-2].lower(), last[-1].strip()
    if word == "join":
        return True
    if word in ("on", "where", "and", "or", "having"):
        return not re.search(r"[=<>]\s*\S|\b(?:like|in|is|between|exists|glob|match|not)\b\s*\S", rest, re.I)
    return False


def language(text: str) -> tuple[str | None, int]:
    """The language whose function words a text has most, and by how many it leads; zh by its characters."""
    text = re.sub(r"`[^`]*`|'[^']*'|\"[^\"\s]*\"|\b\w*[_\d.]\w*\b", " ", text)
    han = len(re.findall(r"[一-鿿]", text))
    words = re.findall(r"[^\W\d_]+", re.sub(r"[一-鿿]+", " ", text.lower()))
    if han >= 4 and han >= len(words):
        return "zh", han
    hits = sorted(((sum(w in known for w in words), lang) for lang, known in _WORDS.items()), reverse=True)
    lead = hits[0][0] - hits[1][0]
    return (hits[0][1], lead) if lead > 0 else (None, 0)


def _key(text: str) -> bytes:
    """A text's words and numbers in lower case, for comparison."""
    return " ".join(re.findall(r"[一-鿿]|(?:(?![一-鿿])[^\W_])+", text.lower())).encode()


def _cost(text: bytes, dictionary: bytes) -> int:
    """Bytes of text compressed with another text as dictionary."""
    options = zstandard.ZstdCompressionParameters.from_level(9, source_size=len(text), dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options).compress(text))


def is_copy(prompt: str, response: str, slack: int = 20) -> bool:
    """True where prompt and response say the same: each costs next to nothing given the other.

    slack: the bytes of new text, besides a tenth of the prompt, that a response may add, such as "The task is to".
    """
    p, r = _key(prompt), _key(response)
    if len(p) < 8 or len(r) < 0.6 * len(p):
        return False
    if p == r:
        return True
    same = _cost(p, p)
    return _cost(r, p) - same <= slack + len(p) // 10 and _cost(p, r) - same <= 4 + len(p) // 10


def context(text: str) -> str:
    """The last words of a text, digits as 0, in the form that context_key() reads."""
    text = re.sub(TRAILING, "", text)
    if re.search(r"[一-鿿]$", text):
        return re.sub(r"\d+", "0", text)[-4:]
    return " ".join(re.sub(r"\d+", "0", " ".join(text.split()[-CONTEXT_WORDS:])).lower().split())


def judge(prompt: str | None, raw: str | None) -> tuple[str | None, str | None]:
    """(defect, None), (None, context to be looked up) or (None, None) for a sound pair."""
    u = Unwrapped(raw or "")
    prose = "\n".join(u.prose).strip()
    if not prose and not u.sql:
        return ("truncated", None) if u.open and re.search(r"\w", re.sub(r"[`{}\[\]\"':,\s]|json|sql|action_input|action|</?think>", "", raw or "")) else ("empty", None)
    prompt = prompt or ""
    said = re.sub(r"(?m)^>.*$", " ", prose)
    own = said.replace(prompt.strip(), " ") if len(prompt) > 8 else said
    m = _REFUSAL.search(own.replace("’", "'"))
    if m and not u.sql and not re.search(r"\d", own):
        return "refusal", None
    if not u.sql and is_copy(prompt, prose):
        return "copy", None
    a, b = language(prompt), language(own)
    if a[0] and b[0] and a[0] != b[0] and b[1] >= 2 and a[1] >= 1:
        return "other_language", None
    if u.open or any(sql_open(s) for s in u.sql):
        return "truncated", None
    last = prose.strip()
    tail = last.split("\n")[-1].strip()
    if not last or (_FINAL.search(last) and not tail.endswith("...")):
        return None, None
    if re.search(r"(?:…|\.\.\.|[,;:(\-–—、，；：])$", tail):
        return "truncated", None
    if _SHORT.match(tail) or len(tail.split()) == 1 and not re.search(r"[一-鿿]", tail) and "\n" not in last:
        return None, None
    return None, context(tail)


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [judge(p, r) for p, r in zip(pdf["thought"], pdf["raw_response"], strict=True)]
        out = pd.DataFrame({"step_id": pdf["step_id"], "defect": [d for d, _ in found], "context": [c for _, c in found]})
        yield out[out["defect"].notna() | out["context"].notna()]


#: Where a sentence ends.
FINAL_MARK = r"[.!?](?=[\"'”’»)\]\s]|$)|[。！？]"


def context_key(context: Column) -> Column:
    """The key of a context as context() writes it: of its words, or of itself where it ends in Chinese."""
    words = F.split(context, " ")
    return F.when(context.rlike(r"[\x{4e00}-\x{9fff}]$"), F.xxhash64(context)).otherwise(F.xxhash64(*(F.coalesce(F.try_element_at(words, F.lit(k)), F.lit("")) for k in range(1, CONTEXT_WORDS + 1))))


def context_counts(steps: DataFrame, asked: DataFrame) -> DataFrame:
    """key, ends, inside: how often each asked context ends a sentence of the responses, and how often it stands inside one with more of the sentence after it.

    asked: key. One pass over the responses; runs of words are met by their
    keys and never written as text, and only those asked for are counted.
    """
    text = F.regexp_replace("raw_response", r"\\n", " ")
    pieces = steps.select(F.split(text, FINAL_MARK).alias("p")).select(F.posexplode("p").alias("k", "s"), (F.size("p") - 1).alias("last"))
    # What stands after the last final mark ends no sentence; the pieces before do.
    tails = pieces.select((F.col("k") < F.col("last")).alias("whole"), F.regexp_replace(F.lower(F.regexp_replace("s", TRAILING, "")), r"\d+", "0").alias("t")).where("t rlike '\\\\S'")
    cut = tails.select("whole", "t", F.col("t").rlike(r"[\x{4e00}-\x{9fff}]$").alias("han"), F.split(F.trim("t"), r"\s+").alias("w"))
    n, bare = F.size("w"), lambda c: F.regexp_replace(c, TRAILING, "")
    word = lambda k: F.coalesce(F.try_element_at("w", k), F.lit(""))
    run = lambda k: F.xxhash64(*(word(k + i) for i in range(CONTEXT_WORDS - 1)), bare(word(k + CONTEXT_WORDS - 1)))
    at = lambda key, end: F.struct(key.alias("key"), end.alias("end"))
    inner = F.when(n > CONTEXT_WORDS, F.transform(F.sequence(F.lit(1), n - CONTEXT_WORDS), lambda k: at(run(k), F.lit(False)))).otherwise(F.array().cast("array<struct<key:bigint,end:boolean>>"))
    first = F.greatest(n - CONTEXT_WORDS + 1, F.lit(1))
    final = F.when(F.col("whole"), F.array(at(F.when(F.col("han"), F.xxhash64(F.right("t", F.lit(4)))).otherwise(run(first)), F.lit(True)))).otherwise(F.array().cast("array<struct<key:bigint,end:boolean>>"))
    han = F.transform(F.regexp_extract_all("t", F.lit(r"(?s)(?=(.{3}[\x{4e00}-\x{9fff}]).)"), 1), lambda c: at(F.xxhash64(c), F.lit(False)))
    met = cut.select(F.explode(F.concat(inner, final, F.when(F.col("t").rlike(r"[\x{4e00}-\x{9fff}]"), han).otherwise(F.array().cast("array<struct<key:bigint,end:boolean>>")))).alias("x")).select("x.key", "x.end")
    return met.join(broadcast_if_small(asked), "key", "left_semi").groupBy("key").agg(F.count_if("end").alias("ends"), F.count_if(~F.col("end")).alias("inside"))


def broken_pairs(steps: DataFrame) -> DataFrame:
    """step_id and defect (empty, truncated, refusal, copy, other_language) of every defective pair.

    steps: step_id, thought, raw_response. A null response is empty; without a
    thought there is no copy and no language to compare with. A pair gets the
    first defect that applies, in the order empty, refusal, copy, other
    language, truncated. Repeated steps are judged each.
    """
    steps = steps.select("step_id", "thought", "raw_response")
    judged = materialise(steps.mapInPandas(_judged, "step_id bigint, defect string, context string"))
    keyed = judged.withColumn("key", F.when(F.col("context").isNotNull(), context_key(F.col("context"))))
    counts = context_counts(steps.where("raw_response is not null"), keyed.where("key is not null").select("key").distinct())
    open_ = keyed.where("key is not null").join(counts, "key", "left")
    # Of two counts that grow alike, the larger tells what the context mostly does, whatever the number of rows.
    cut = F.coalesce("ends", F.lit(0)) <= F.coalesce("inside", F.lit(0))
    broken_off = open_.where(cut).select("step_id", F.lit("truncated").alias("defect"))
    return keyed.where("defect is not null").select("step_id", "defect").unionByName(broken_off)


def pairs_of(spark, sf_dir: str) -> DataFrame:
    return broken_pairs(spread(load(spark, sf_dir, "step_record").select("step_id", "thought", "raw_response")))
