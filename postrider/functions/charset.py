"""Charsets of undeclared bytes: byte-pair models, scored over whole Arrow buffers.

A model says for each pair of bytes how likely the second is after the first, in
texts of one charset.  Pairs of two ASCII bytes say nothing and are left out, so
English words in a file do not speak for any charset.  Models are fitted by counting
the pairs of sample texts in each charset: a table of fixed size, whatever the
samples.  One more model holds all bytes equally likely; it wins on bytes that are
no text at all.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A guess under this is not taken; the bytes are read as latin-1.
CONFIDENCE = 0.5
SCALE = 1000
#: What speaks for a charset before any byte is read, as floored log shares: most files without a mark that are not UTF-8 are Western Windows ones.
PRIOR = {"cp1252": 3 * SCALE}
_SEEN = 0.7
_BROKEN = 10 * SCALE
_BLOCK = 4 << 20
_MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))

#: Sample texts of the default models: (charsets, text).
SAMPLES = (
    (("cp1252", "cp850", "mac_roman"), "Chère Madame, veuillez trouver ci-joint la facture du mois dernier. Après réception, nous vous prions de régler le solde à l'échéance prévue. L'équipe a été très contente de votre réponse; où êtes-vous déjà allés cet été? Ça ira, peut-être même bientôt, là où c'est possible. À bientôt, Élodie"),
    (("cp1252", "cp850", "mac_roman"), "Sehr geehrte Damen und Herren, anbei erhalten Sie die Rechnung für den vergangenen Monat. Können Sie uns bitte bestätigen, dass die Änderungen übernommen wurden? Wir würden uns über eine Rückmeldung freuen. Schöne Grüße aus München, Straße und Größe wie gewöhnlich. Übrigens, Ärger gab es nicht. Österreich"),
    (("cp1252", "cp850", "mac_roman"), "Estimado señor, adjuntamos la factura del año pasado. La reunión será mañana después de las diez; ¿podría usted confirmar su participación? También queríamos decirle que la información está aquí. El niño comió en el jardín. ¡Gracias y saludos, María Núñez! Así fue según él. Qué día más único"),
    (("cp1252", "cp850", "mac_roman"), "Prezado senhor, segue em anexo a fatura do mês passado. A reunião será amanhã e não há alterações; as informações estão à disposição. Você também poderá enviar a confirmação até sábado. Atenção às condições, João"),
    (("cp1252", "cp850", "mac_roman"), "Hej, bifogat finner du fakturan för förra månaden. Vi skulle vilja träffa dig på måndag, går det bra? Även de övriga är välkomna. På gården växer många blå blommor, så är det här. Kære venner, vi glæder os til at høre fra jer, når I får tid. Mvh Åsa, Øystein"),
    (("cp1250", "iso8859_2"), "Szanowni Państwo, w załączniku przesyłamy fakturę za ubiegły miesiąc. Proszę o potwierdzenie, że zmiany zostały wprowadzone. Dziękujemy za szybką odpowiedź; będziemy wdzięczni również za uwagi. Właśnie się dowiedziałem, że źródło jest już dostępne. Łódź, Śląsk, święta"),
    (("cp1250", "iso8859_2"), "Vážená paní, v příloze zasíláme fakturu za minulý měsíc. Prosíme o potvrzení, že změny byly přijaty. Těšíme se na vaši odpověď, která může přijít i později. Žluťoučký kůň úpěl ďábelské ódy. Také děkujeme za všechny připomínky, šťastnou cestu a čtvrtek"),
    (("cp1250", "iso8859_2"), "Tisztelt Uram, mellékelten küldjük a múlt havi számlát. Kérjük, erősítse meg, hogy a módosítások megtörténtek. Köszönjük a gyors választ, és örülünk, ha később is írnak nekünk. Úgy tűnik, hogy minden rendben van, őszintén üdvözöljük önöket"),
    (("cp1251", "koi8_r", "iso8859_5", "cp866"), "Уважаемые коллеги, во вложении находится счёт за прошлый месяц. Просим вас подтвердить получение документов и сообщить, когда можно будет провести встречу. Мы также хотели бы узнать, что вы думаете об этом предложении. Если у вас есть вопросы, напишите нам, и мы ответим как можно скорее. Это было хорошее время для всех, кто работал вместе. С уважением, Анна Петрова. Сегодня люди говорят только о погоде"),
    (("cp1253", "iso8859_7"), "Αγαπητοί συνάδελφοι, επισυνάπτεται το τιμολόγιο του προηγούμενου μήνα. Παρακαλούμε να επιβεβαιώσετε ότι λάβατε τα έγγραφα και να μας πείτε πότε μπορεί να γίνει η συνάντηση. Θα θέλαμε επίσης να μάθουμε τη γνώμη σας για την πρόταση αυτή. Ευχαριστούμε πολύ, με εκτίμηση. Ήταν μια καλή ημέρα για όλους εμάς"),
    (("cp1254",), "Sayın yetkili, geçen aya ait fatura ektedir. Değişikliklerin yapıldığını lütfen onaylayınız. Görüşmek üzere, hızlı yanıtınız için teşekkür ederiz; sorularınız varsa bize yazabilirsiniz. Bugün çalışma arkadaşlarımızla ığdır şehrine gittik. İstanbul'da güneşli bir gün, şimdi değil"),
    (("cp1255",), "שלום רב, מצורפת החשבונית של החודש שעבר. נא לאשר את קבלת המסמכים ולהודיע לנו מתי אפשר לקיים את הפגישה. נשמח גם לדעת מה דעתכם על ההצעה הזאת. אם יש לכם שאלות, כתבו לנו ונענה בהקדם. תודה רבה ובברכה"),
    (("cp1256",), "السادة الكرام، تجدون مرفقا فاتورة الشهر الماضي. نرجو تأكيد استلام الوثائق وإبلاغنا متى يمكن عقد الاجتماع. نود أيضا أن نعرف رأيكم في هذا الاقتراح. إذا كانت لديكم أسئلة فاكتبوا إلينا وسنجيب في أقرب وقت. شكرا جزيلا مع التحية"),
    (("cp932", "euc_jp"), "いつもお世話になっております。先月分の請求書を添付いたしましたので、ご確認をお願いいたします。会議の日程については、来週の月曜日に決めたいと思います。ご質問がありましたら、メールでお知らせください。よろしくお願いいたします。このサービスはインターネットで使うことができます。東京の天気は良く、私たちは新しい仕事を始めました。"),
    (("gb18030",), "尊敬的各位同事，附件是上个月的发票，请查收并确认。会议的时间可以在下个星期一决定，如果有问题请给我们发邮件。我们也想知道你们对这个建议的看法。谢谢大家的支持和合作。今天的天气很好，人们都在公园里工作和学习，中国的经济发展很快，这是一个新的开始。"),
    (("big5",), "各位同事您好，附件是上個月的發票，請查收並確認。會議的時間可以在下個星期一決定，如果有問題請給我們發郵件。我們也想知道你們對這個建議的看法。謝謝大家的支持與合作。今天的天氣很好，人們都在公園裡工作和學習，臺灣的經濟發展很快，這是一個新的開始。"),
    (("cp949",), "안녕하세요, 지난달 청구서를 첨부하였으니 확인해 주시기 바랍니다. 회의 일정은 다음 주 월요일에 결정하고자 합니다. 질문이 있으시면 메일로 알려 주십시오. 이 제안에 대한 여러분의 의견도 알고 싶습니다. 감사합니다. 오늘은 날씨가 좋아서 많은 사람들이 공원에서 시간을 보내고 있습니다."),
)


@dataclass
class Charsets:
    """weights[i, a * 256 + b]: what byte b after byte a says for the charset names[i]; the last row is that of bytes by chance."""

    names: list[str]
    weights: np.ndarray


def pair_counts(text: str, charset: str) -> np.ndarray:
    """How often each pair of bytes with one beyond ASCII occurs in a text written in a charset; characters that it lacks part the text."""
    out = np.zeros(1 << 16, np.int64)
    for part in text.encode(charset, "replace").split(b"?"):
        raw = np.frombuffer(part, np.uint8).astype(np.int64)
        pairs = raw[:-1] * 256 + raw[1:]
        out += np.bincount(pairs[(pairs & 0x8080) > 0], minlength=1 << 16)
    return out


def model_of(counts: dict[str, np.ndarray]) -> Charsets:
    """Models by interpolation: a pair's share after its first byte, its second byte's share, and chance."""
    names = sorted(counts)
    weights = np.full((len(names) + 1, 1 << 16), np.floor(SCALE * np.log(1 / 256)), np.int32)
    for i, name in enumerate(names):
        c = counts[name].reshape(256, 256).astype(float)
        second = (c.sum(axis=0) + 0.05) / (c.sum() + 0.05 * 256)
        first = c.sum(axis=1, keepdims=True)
        seen = _SEEN * first / (first + 5)
        p = seen * c / np.maximum(first, 1) + (1 - seen) * second
        weights[i] = np.floor(SCALE * np.log(p)).astype(np.int32).ravel()
    return Charsets(names, weights)


@functools.cache
def default_model() -> Charsets:
    counts: dict[str, np.ndarray] = {}
    for charsets, text in SAMPLES:
        for name in charsets:
            counts[name] = counts.get(name, 0) + pair_counts(text, name)
    return model_of(counts)


def fit(samples: DataFrame, charset_col: str = "charset", text_col: str = "text", with_default: bool = True) -> Charsets:
    """Models of (charset, text) rows, together with the default samples or without.

    A row without a charset or a text, or with a charset that nobody knows, teaches
    nothing.  Each task sends its sums: at most 65,536 a charset, which is also all
    that comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    held[name] = held.get(name, 0) + pair_counts(text, name)
                except LookupError:
                    continue
        for name, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], names=["charset", "pair", "n"])

    known = samples.select(F.col(charset_col).alias("charset"), F.col(text_col).alias("text")).filter("charset IS NOT NULL AND text IS NOT NULL")
    found = known.mapInArrow(count, "charset string, pair long, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for charsets, text in SAMPLES if with_default else ():
        for name in charsets:
            counts[name] = counts.get(name, 0) + pair_counts(text, name)
    names, pairs, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("charset", "pair", "n"))
    for name in set(names.tolist()):
        own = names == name
        counts.setdefault(name, np.zeros(1 << 16, np.int64))[pairs[own]] += n[own]
    return model_of(counts)


def scores(raw: np.ndarray, offsets: np.ndarray, model: Charsets) -> np.ndarray:
    """[row, charset]: sums of weights over the byte pairs of each row of a buffer, read in blocks; no pair crosses a row's end."""
    out = np.zeros((len(offsets) - 1, len(model.weights)))
    for low in range(int(offsets[0]), int(offsets[-1]) - 1, _BLOCK):
        part = raw[low : min(low + _BLOCK + 1, int(offsets[-1]))].astype(np.int32)
        pairs = part[:-1] * 256 + part[1:]
        at = np.flatnonzero(pairs & 0x8080)
        row = np.searchsorted(offsets, at + low, "right") - 1
        inside = at + low + 1 < offsets[row + 1]
        at, row = at[inside], row[inside]
        for i, weights in enumerate(model.weights):
            out[:, i] += np.bincount(row, weights[pairs[at]], len(out))
    return out


def _chosen(data: bytes, score: np.ndarray, names: list[str]) -> tuple[str, str, float]:
    """(text, charset, confidence) by scores.  The three best read the bytes; what they cannot read counts against them, and those that read the same count together."""
    score = score + np.array([*(PRIOR.get(name, 0) for name in names), 0])
    read: dict[int, str] = {}
    for i in np.argsort(-score[:-1], kind="stable")[:3].tolist():
        read[i] = data.decode(names[i], "replace")
        score[i] -= _BROKEN * read[i].count("�")
    share = np.exp((score - score.max()) / SCALE)
    share /= share.sum()
    if not read:
        return data.decode("latin-1"), "latin-1", 0.0
    best = max(read, key=lambda i: score[i])
    sure = float(sum(share[i] for i, text in read.items() if text == read[best]))
    return (read[best], names[best], sure) if sure >= CONFIDENCE else (data.decode("latin-1"), "latin-1", sure)


def _plain(data: bytes) -> tuple[str, str, float] | None:
    """Bytes with a byte order mark, and UTF-8."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            try:
                return data.decode(name), name.removesuffix("-sig"), 1.0
            except UnicodeDecodeError:
                break
    try:
        return data.decode(), "utf-8", 1.0
    except UnicodeDecodeError:
        return None


def decode(data: bytes, model: Charsets | None = None) -> tuple[str, str, float]:
    """(text, charset, confidence) of one file's bytes: by its mark, as UTF-8, by the models, or else latin-1."""
    found = _plain(data)
    if found is None:
        model = model or default_model()
        found = _chosen(data, scores(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model)[0], model.names)
    return found


def decoded(content: Column, model: Charsets | None = None, docs: DataFrame | None = None) -> Column:
    """struct(text, charset, confidence) of a column of bytes: ``decode`` of each, null of null.

    ``model`` is broadcast through the session of ``docs`` (a quarter megabyte a
    charset); without one each worker makes the default models.  Empty bytes are empty
    UTF-8; very long ones are read in blocks, whole.
    """
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<text:string,charset:string,confidence:double>")
    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        found = [None if x is None else _plain(x) for x in rows]
        left = [i for i, x in enumerate(rows) if x is not None and found[i] is None]
        if left:
            model = default_model() if shared is None else shared.value
            offsets = np.concatenate([[0], np.cumsum([len(rows[i]) for i in left])])
            score = scores(np.frombuffer(b"".join(rows[i] for i in left), np.uint8), offsets, model)
            for i, own in zip(left, score):
                found[i] = _chosen(rows[i], own, model.names)
        out = [None if x is None else {"text": x[0], "charset": x[1], "confidence": x[2]} for x in found]
        return pa.array(out, pa.struct([("text", pa.string()), ("charset", pa.string()), ("confidence", pa.float64())]))

    return run(content)


def encoded(text: Column, charset: Column) -> Column:
    """Bytes of a text in its row's charset, in UTF-8 where that lacks a character or is unknown; null of null."""

    def written(text: str | None, name: str | None) -> bytes | None:
        try:
            return None if text is None else text.encode(name or "utf-8")
        except (LookupError, UnicodeEncodeError):
            return text.encode("utf-8", "replace")

    @F.arrow_udf("binary")
    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([written(t, n) for t, n in zip(texts.to_pylist(), names.to_pylist())], pa.binary())

    return run(text, charset)
