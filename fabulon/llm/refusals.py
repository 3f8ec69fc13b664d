"""A grammar of refusals in nine languages (used by problem 2).

A refusal is a sentence outside quoted speech in which the speaker can't, may not or won't do something, followed (or,
in languages with the verb last, accompanied) by the act or the task in question; or a statement that the task lies
beyond what the speaker may do; or one about the speaker's rules.
"""

from __future__ import annotations

import re

# Who declines ("unable"), what is declined ("act"), and sentences that decline by themselves ("rule").
GRAMMAR = {
    "en": {
        "unable": r"\bI(?:['’]m| am)(?: \w+,?)? (?:unable|not able|not allowed|not permitted|not in a position|forbidden|prohibited)"
        r"|\bI (?:can(?:['’]t|not| not)|won['’]t|will not|must|have to|am obliged to|prefer not|would rather not) "
        r"|\bI['’]ll (?:have to|need to) |\bI (?:\w+ly )?(?:decline|refuse)\b",
        "weak": r"\b(?:help|assist\w*|support|do (?:that|this|so))\b",
        "act": r"\b(?:help with (?:this|that) \w+|complet\w+|comply\w*|fulfil\w*|provid\w+|produc\w+|translat\w+|continu\w+|generat\w+|respond\w*|engage"
        r"|proceed|carry out|decline|refuse|pass on|creat\w+|requests?|task|content|material"
        r"|(?:this|that|the|your) (?:text|chapter|passage|question|excerpt))\b",
        "rule": r"\b(?:as an (?:AI|assistant|language model)\b|(?:not something|beyond what|outside what|more than) I (?:can|may|am)\b"
        r"|(?:my|our) (?:guidelines|policies|policy|instructions|rules) (?:do(?:es)? not|don['’]t|doesn['’]t|prevents?|forbids?|prohibits?)"
        r"|against my (?:guidelines|policies|instructions|rules))",
    },
    "fr": {
        "unable": r"\bje (?:ne (?:peux|puis|suis|saurais|pourrai|souhaite) |dois (?:refuser|décliner|renoncer)|préfère ne pas|refuse\b|décline\b"
        r"|regrette\b|suis (?:désolée?|navrée?|au regret|dans l['’]impossibilité))|\bje n['’]ai pas (?:le droit|la possibilité)"
        r"|\bil m['’]est (?:impossible|interdit)|m['’]excuse|toutes mes excuses",
        "weak": r"\b(?:vous (?:y )?aider|faire (?:cela|ça))\b",
        "act": r"\b(?:demandes?|tâche|tradui\w+|poursui\w+|continuer|fournir|produire|rédiger|contenu|donner suite|y répondre|accéder à|satisfaire"
        r"|aider (?:avec|pour) cette|(?:ce|cet|cette|votre) (?:texte|chapitre|passage|extrait|question))",
        "rule": r"\ben tant qu['’](?:IA|assistant|intelligence)|\b(?:dépasse|sort du cadre de|excède) ce que (?:j['’]ai le droit|je (?:peux|puis|suis autorisée?))"
        r"|\bmes (?:consignes|instructions|règles) (?:me l['’]interdisent|ne (?:me )?le permettent pas|m['’]en empêchent|m['’]interdisent)",
    },
    "de": {
        "unable": r"\bich (?:kann|darf|werde|möchte|will)\b[^.]*?\b(?:nicht|keine?n?)\b|\b(?:kann|darf|möchte|werde) ich\b[^.]*?\b(?:nicht|keine?n?)\b"
        r"|\bich bin (?:leider )?(?:nicht in der Lage|außerstande|nicht befugt)|\bich (?:muss|lehne)\b[^.]*?\bab(?:lehnen)?\b"
        r"|\bes ist mir (?:leider )?(?:nicht (?:möglich|erlaubt|gestattet)|untersagt)",
        "weak": r"helfen|unterstütz|\bdas (?:nicht )?tun\b",
        "act": r"übersetz|fortsetz|fortfahr|bereitstell|liefern|verfassen|beantwort|erfüllen|nachkommen|ablehnen|\b(?:Anfrage|Bitte|Aufgabe|Inhalte?)\b"
        r"|\b(?:diese[nmrs]?|den|das) (?:Text|Kapitel|Abschnitt|Frage)\b",
        "rule": r"\bals (?:KI|Assistent|Sprachmodell)\b|\bmeine (?:Richtlinien|Vorgaben|Anweisungen) (?:erlauben|verbieten|lassen|untersagen)",
    },
    "es": {
        "unable": r"\bno (?:puedo|podré|me es posible|me está permitido|tengo permitido)\b|\bno estoy (?:en condiciones|autorizad[oa]|capacitad[oa])"
        r"|\bdebo (?:rechazar|declinar|negarme)|\bme niego a\b|\b(?:lamento|siento) no poder\b",
        "weak": r"ayud|asist|\bhacer (?:eso|esto)\b",
        "act": r"traduc|traduz|continu|proporcion|producir|generar|respond|cumplir|atender|complet|rechazar|declinar|solicitud|petición|tarea|contenido"
        r"|\b(?:este|esta|ese|esa|el|la) (?:texto|capítulo|pasaje|pregunta)\b",
        "rule": r"\bcomo (?:IA|asistente|modelo de lenguaje)\b|\bmis (?:directrices|normas|instrucciones|políticas) (?:no|me lo|lo) ",
    },
    "ru": {
        "unable": r"\bя (?:[^.]*?\b)?не (?:могу|смогу|вправе|имею права|в состоянии|стану)\b|\bя вынужден\w? (?:отказать|отклонить)|\bя отказываюсь\b"
        r"|\bмне (?:нельзя|запрещено|не разрешено)|\bк сожалению, не (?:могу|смогу)\b",
        "weak": r"помо|\b(?:это сделать|сделать это)\b",
        "act": r"перев|продолж|предостав|ответ|выполн|отказать|отклонить|запрос|задач|задани|просьб|содержани|\b(?:этот|эту|этой|этого) (?:текст|глав|отрыв|вопрос)",
        "rule": r"\bкак (?:ИИ|ассистент|помощник|языковая модель)\b|\bмои (?:правила|инструкции) (?:не|запрещ)",
    },
    "zh": {
        "unable": r"(?:我|本人|抱歉[，,]?|遗憾[，,]?)(?:很抱歉)?(?:无法|不能|不便|没法|不可以|未被允许|必须拒绝|只能拒绝|拒绝)",
        "weak": r"帮|协助",
        "act": r"翻译|继续|提供|回答|完成|处理|满足|请求|任务|这(?:段|个|篇|一)?(?:内容|文本|文字|章节|问题)",
        "rule": r"作为(?:一个|一名)?(?:AI|人工智能|助手|语言模型)|超出(?:了)?我(?:可以|能够|被允许)|我的(?:准则|规定|指南)(?:不允许|禁止)",
    },
    "ja": {
        "unable": r"できません|できかねます|いたしかねます|しかねます|お断り|許可されていません|応じられません",
        "weak": r"手伝|協力",
        "act": r"翻訳|続き|続け|提供|回答|お答え|要望|依頼|作成|支援|対応|リクエスト|この(?:内容|文章|テキスト|章|質問)",
        "rule": r"(?:AI|アシスタント|言語モデル)として|ガイドライン(?:により|で禁|では許)",
    },
    "hi": {
        "unable": r"मैं[^।]*?(?:नहीं (?:कर|दे|लिख) सक|असमर्थ|अनुमति नहीं|अस्वीकार|मना कर)|मुझे[^।]*?अनुमति नहीं",
        "weak": r"मदद|सहायता",
        "act": r"अनुवाद|जारी|प्रदान|उत्तर|जवाब|अनुरोध|कार्य|काम|सामग्री|इस (?:पाठ|अध्याय|प्रश्न)",
        "rule": r"(?:एआई|AI|सहायक|भाषा मॉडल) के (?:रूप में|नाते)|मेरे (?:दिशानिर्देश|नियम)[^।]*?नहीं",
    },
    "th": {
        "unable": r"(?:ฉัน|ผม|ดิฉัน|ขออภัย|เสียใจ)[^\n]{0,}?(?:ไม่สามารถ|ไม่อาจ|ไม่ได้รับอนุญาต|ขอปฏิเสธ|ต้องปฏิเสธ)",
        "weak": r"ช่วย",
        "act": r"แปล|ดำเนินการ|ให้(?:ข้อมูล|เนื้อหา)|ตอบ|คำขอ|งานนี้|เนื้อหา|ข้อความนี้|บทนี้|คำถาม",
        "rule": r"ในฐานะ(?:เอไอ|AI|ผู้ช่วย|แบบจำลองภาษา)|แนวทางของ(?:ฉัน|ผม)ไม่อนุญาต",
    },
}
# Words of apology and turning.  The weak acts (helping, doing) are common in stories too, so a sentence with
# one declines only from its beginning or after such a word.
HEDGES = (
    r"sorry|afraid|unfortunately|regret|apolog|however|\bbut\b|thank|désol|malheureusement|hélas|navr|pardon|excus|leider|tut mir leid|entschuldig"
    r"|lo siento|lament|desgracia|сожалени|извин|прост|抱歉|遗憾|对不起|申し訳|すみません|残念|恐れ入り|क्षमा|माफ|खेद|ขออภัย|เสียใจ|ขอโทษ"
)
#: Languages whose act may stand before the inability.
VERB_LAST = ("de", "ja", "hi", "zh")

# Letters, in lower case, without which a text can hold no inability and no rule of the language.
HINTS = {
    "en": (("i can", "i won", "i will", "i must", "i have", "i am", "i'", "i’", "i prefer", "i would", "ly decline", "ly refuse", "i decline", "i refuse"),
           ("as an ", "i can", "i may", "i am", "guideline", "polic", "instruction", "rules")),
    "fr": (("je n", "je d", "je p", "je r", "je s", "il m", "m'ex", "m’ex", "excuses"), ("en tant qu", "ce que j", "mes ")),
    "de": (("ich",), ("als ", "meine ")),
    "es": (("no p", "no m", "no e", "no t", "debo ", "niego"), ("como ", "mis ")),
    "ru": (("я ", "мне ", "сожален"), ("как ", "мои ")),
    "zh": (("无法", "不能", "不便", "没法", "不可以", "未被允许", "拒绝"), ("作为", "超出", "我的")),
    "ja": (("できません", "かねます", "お断り", "許可され", "応じられ"), ("として", "ガイドライン")),
    "hi": (("मैं", "मुझे"), ("के रूप में", "के नाते", "मेरे")),
    "th": (("ไม่สามารถ", "ไม่อาจ", "ไม่ได้รับ", "ปฏิเสธ"), ("ในฐานะ", "แนวทาง")),
}

_UNABLE = {k: re.compile(v["unable"], re.I) for k, v in GRAMMAR.items()}
_ACT = {k: re.compile(v["act"], re.I) for k, v in GRAMMAR.items()}
_WEAK = {k: re.compile(v["weak"], re.I) for k, v in GRAMMAR.items()}
_RULE = {k: re.compile(v["rule"], re.I) for k, v in GRAMMAR.items()}
_HEDGE = re.compile(HEDGES, re.I)
_QUOTED = re.compile(r"«[^»]*(?:»|\Z)|“[^”]*(?:”|\Z)|„[^“”]*(?:[“”]|\Z)|\"[^\"]*(?:\"|\Z)|「[^」]*(?:」|\Z)|^[^\S\n]*[—–][^\n]*", re.M)
_SENTENCE = re.compile(r"[^.!?\n\]。！？।]+")


def is_refusal(text: str) -> bool:
    """A sentence of ``text`` outside quoted speech (marks or a dash at the beginning of a line) declines the task."""
    low = text.lower()
    unable = [k for k, (hints, _) in HINTS.items() if any(h in low for h in hints) and _UNABLE[k].search(text)]
    ruled = [k for k, (_, hints) in HINTS.items() if any(h in low for h in hints) and _RULE[k].search(text)]
    if not unable and not ruled:
        return False
    plain = _QUOTED.sub(" ", text)
    if any(_RULE[k].search(plain) for k in ruled):
        return True
    for s in _SENTENCE.findall(plain):
        for lang in unable:
            m = _UNABLE[lang].search(s)
            if not m:
                continue
            # an act inside the words of inability ("must decline") counts as well
            at = 0 if lang in VERB_LAST else m.start()
            if _ACT[lang].search(s, at):
                return True
            if _WEAK[lang].search(s, at) and (not s[: m.start()].strip(" \"'«“„「—–-") or _HEDGE.search(s, 0, m.end())):
                return True
    return False
