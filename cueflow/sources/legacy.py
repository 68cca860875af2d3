"""Which legacy code page content was written in, by letter bigrams of the languages a page was made for.

A candidate page must decode the content without a gap. Pages of scripts other than Latin need more than
half of the letters in their script, counted over whole words that hold a letter above ASCII: a Latin word
with accents is never read as Cyrillic, Greek, Hebrew, Arabic or East Asian. What remains is scored:

- single-byte pages by the letters above ASCII: how many belong to a language of the page, and how many
  of the letter pairs they stand in (word edges included) occur in the language's sample text;
- East Asian pages by their letters: how many are kana, Hangul or ideographs of the first level of the
  national standard, and how many are among the language's most frequent signs.

Signs that prose does not use, and marks inside words, count against a page. Ties go to the page named first.
"""

from __future__ import annotations

import functools
import re

import numpy as np

# Some sentences per language; their letters and letter pairs are the language's profile.
SAMPLES = {
    "tr": "bugün hava çok güzel değil mi? evet, ama yarın yağmur yağacakmış. şöyle ığdır çiçeği gibi öğründü, çünkü üşüdü. kızım, ağır ışığı söndür, artık uyuyalım. çıkışta görüşürüz, işim bitince sana geleceğim. şaşırdığı için hiçbir şey söyleyemedi. öğretmenim, bu sorunun cevabını bilmiyorum. ağaçların altında büyük bir köpek vardı, kuş gibi uçtu gitti. teşekkür ederim, özür dilerim, lütfen bağışla. ne yapacağız şimdi? bırak onu, kaçış yok. dışarı çık, içeri gir, yüzüğü göster. doğru, yanlış, kış, kışı, ışık, başı, baş, düş, güneş, müşteri, İstanbul'a İzmir'den gelmiş. Şimdi mi? Çok şükür. Ölüm. Üç.",
    "ru": "привет, как дела? всё хорошо, спасибо. я не знаю, что делать дальше. где ты был вчера вечером? мы ждали тебя целый час. это очень важно для меня, понимаешь? он сказал, что придёт завтра утром. пожалуйста, помоги мне найти мою собаку. сегодня на улице холодно и идёт снег. люди часто говорят о том, чего не знают. женщина вышла из дома и пошла к реке. его жизнь изменилась, когда началась война. хочешь ещё чаю? нет, больше ничего не нужно. объект, подъезд, съёмка, эхо, юг, шум, щука, фильм, цена.",
    "el": "καλημέρα σας, τι κάνετε; είμαι πολύ καλά, ευχαριστώ. δεν ξέρω τι να κάνω τώρα. πού ήσουν χθες το βράδυ; σε περιμέναμε μια ώρα. αυτό είναι πολύ σημαντικό για μένα, καταλαβαίνεις; είπε ότι θα έρθει αύριο το πρωί. σε παρακαλώ, βοήθησέ με να βρω τον σκύλο μου. σήμερα έξω κάνει κρύο και χιονίζει. οι άνθρωποι συχνά μιλούν για όσα δεν γνωρίζουν. η γυναίκα βγήκε από το σπίτι και πήγε στο ποτάμι. η ζωή του άλλαξε όταν άρχισε ο πόλεμος. θέλεις κι άλλο; όχι, φτάνει. ψυχή, ξύλο, ζωή, φως, ωραίος, ύπνος, όλοι.",
    "pl": "dzień dobry, jak się masz? dziękuję, wszystko w porządku. nie wiem, co mam teraz zrobić. gdzie byłeś wczoraj wieczorem? czekaliśmy na ciebie całą godzinę. to jest dla mnie bardzo ważne, rozumiesz? powiedział, że przyjdzie jutro rano. proszę, pomóż mi znaleźć mojego psa. są ludzie, którzy mówią o tym, czego nie znają. kobieta wyszła z domu i poszła nad rzekę. życie się zmieniło, gdy zaczęła się wojna. chcesz jeszcze? już nie, słońce świeci, źle, żółć, gęś, jaźń, łódź, książę, ćma.",
    "cs": "dobrý den, jak se máte? děkuji, všechno je v pořádku. nevím, co mám teď dělat. kde jsi byl včera večer? čekali jsme na tebe celou hodinu. to je pro mě velmi důležité, rozumíš? řekl, že přijde zítra ráno. prosím, pomoz mi najít mého psa. lidé často mluví o tom, co neznají. žena vyšla z domu a šla k řece. jeho život se změnil, když začala válka. chceš ještě čaj? už ne, příliš žluťoučký kůň úpěl ďábelské ódy. šťastný, ľúbiť, môj, dieťa, päť.",
    "hu": "jó napot, hogy vagy? köszönöm, minden rendben van. nem tudom, mit csináljak most. hol voltál tegnap este? egy órát vártunk rád. ez nagyon fontos nekem, érted? azt mondta, hogy holnap reggel jön. kérlek, segíts megtalálni a kutyámat. az emberek gyakran beszélnek arról, amit nem ismernek. a nő kiment a házból és a folyóhoz ment. megváltozott az élete, amikor elkezdődött a háború. kérsz még? már nem, hűség, győr, tűz, őrült, öröm, ünnep, fű, nő, szőlő, sütő.",
    "ro": "bună ziua, ce mai faceţi? mulţumesc, totul e bine. nu ştiu ce să fac acum. unde ai fost aseară? te-am aşteptat o oră întreagă. este foarte important pentru mine, înţelegi? a spus că vine mâine dimineaţă. te rog, ajută-mă să-mi găsesc câinele. oamenii vorbesc adesea despre ce nu ştiu. viaţa lui s-a schimbat când a început războiul. şi, aţi, faţă, piaţă, însă, până.",
    "fr": "bonjour, comment ça va? très bien, merci. je ne sais pas ce que je dois faire à présent. où étais-tu hier soir? nous t'avons attendu pendant une heure. c'est très important pour moi, tu comprends? il a déjà dit qu'il viendrait demain. s'il te plaît, aide-moi à trouver mon chien, il a été blessé. la fenêtre était fermée, la forêt brûlait. peut-être, bientôt, même, tête, rêve, être, hôtel, sûr, maïs, noël, naïf, garçon, français, leçon, élève, étude, événement, à côté, là, voilà, déjà vu, après, père, mère, frère.",
    "de": "guten tag, wie geht es ihnen? danke, alles ist in ordnung. ich weiß nicht, was ich jetzt tun soll. wo warst du gestern abend? wir haben eine stunde auf dich gewartet. das ist für mich sehr wichtig, verstehst du? er hat gesagt, dass er morgen früh kommt. können sie mir helfen? natürlich, ich möchte gern. schön, größe, straße, mädchen, bäume, häuser, über, übung, fünf, zwölf, hören, böse, löwe, müde, grün, tür, heißt, groß, süß, ärger, öffnen, später, während, könnte, würde, wäre, müssen, zurück, glück.",
    "es": "buenos días, ¿cómo está usted? muy bien, gracias. no sé qué debo hacer ahora. ¿dónde estabas ayer por la noche? te esperamos una hora. es muy importante para mí, ¿entiendes? dijo que vendría mañana. por favor, ayúdame a encontrar mi perro. la señora salió de la casa y fue al río. su corazón, la canción, está, será, aquí, así, también, según, después, jamás, niño, año, español, pequeño, sueño, árbol, último, único, último, él, tú, más, según, habitación, dirección, adiós, difícil, fácil.",
    "pt": "bom dia, como está? muito bem, obrigado. não sei o que devo fazer agora. onde você estava ontem à noite? nós esperamos por você uma hora. é muito importante para mim, você não acha? ele disse que virá amanhã. a mãe, o irmão, as irmãs, coração, canção, são, então, também, é, já, lá, até, você, três, avô, avó, português, céu, informação, questões, ações, lições, júri, água, música.",
    "it": "buongiorno, come sta? molto bene, grazie. non so più che cosa fare, perché è già tardi. dov'eri ieri sera? ti abbiamo aspettato un'ora. è così importante per me, capisci? ha detto che verrà domani. la città, la verità, l'università, però, può, più, giù, lunedì, martedì, sì, né, caffè, libertà, felicità, andrò, sarà, farà.",
    "sv": "god dag, hur mår du? tack, allt är bra. jag vet inte vad jag ska göra nu. var var du i går kväll? vi väntade på dig en timme. det är väldigt viktigt för mig, förstår du? han sa att han kommer i morgon. människor, också, åka, år, då, två, får, här, där, när, själv, röd, höra, öppna, över, större, smör. jeg ved ikke, hvad jeg skal gøre nu, på, når, også, så, få, øje, første, løbe, ære, være, læse, æble, små.",
    "is": "góðan daginn, hvað segir þú? það er allt í lagi, ég veit ekki hvað ég á að gera núna. hvar varst þú í gær? við biðum eftir þér. þetta er mjög mikilvægt fyrir mig. þeir, maður, að, það, við, með, sagði, ný, mýri, dýr.",
    "he": "שלום לכולם, אני הולך הביתה עכשיו. מה שלומך היום? תודה, הכל בסדר. אני לא יודע מה לעשות עכשיו. איפה היית אתמול בערב? חיכינו לך שעה שלמה. זה מאוד חשוב לי, אתה מבין? הוא אמר שהוא יבוא מחר בבוקר. בבקשה, תעזור לי למצוא את הכלב שלי. האישה יצאה מהבית והלכה אל הנהר. חייו השתנו כאשר התחילה המלחמה. עוד קצת? לא, מספיק. ילד טוב, דג, סוף, עץ, צבע, גם כן.",
    "ar": "السلام عليكم، كيف حالك اليوم؟ شكرا، كل شيء بخير. لا أعرف ماذا أفعل الآن. أين كنت مساء أمس؟ انتظرناك ساعة كاملة. هذا مهم جدا بالنسبة لي، هل تفهم؟ قال إنه سيأتي غدا صباحا. من فضلك ساعدني في العثور على كلبي. يتحدث الناس كثيرا عما لا يعرفون. خرجت المرأة من البيت وذهبت إلى النهر. تغيرت حياته عندما بدأت الحرب. هل تريد المزيد؟ ضوء، ظل، غرفة، طفل، صديق، ذلك، هؤلاء، مسؤول، فى، آخر. سلام، چه خبر؟ من نمی دانم چه کار کنم، خانه، پدر، گفت.",
}
# The languages of each page, in the order in which ties are settled.
PAGES = {
    "cp1254": ("tr",),
    "cp1251": ("ru",),
    "koi8_r": ("ru",),
    "cp1253": ("el",),
    "cp1250": ("pl", "cs", "hu", "ro", "de"),
    "cp1252": ("fr", "de", "es", "pt", "it", "sv", "is"),
    "cp1255": ("he",),
    "cp1256": ("ar",),
    "mac_roman": ("fr", "de", "es", "pt", "it", "sv"),
}
# The script of the pages that are not Latin, as ranges of code points.
SCRIPTS = {
    "cp1251": ((0x400, 0x52F),),
    "koi8_r": ((0x400, 0x52F),),
    "cp1253": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cp1255": ((0x590, 0x5FF),),
    "cp1256": ((0x600, 0x6FF), (0x750, 0x77F)),
    "cp932": ((0x3040, 0x30FF), (0x3400, 0x9FFF)),
    "euc_jp": ((0x3040, 0x30FF), (0x3400, 0x9FFF)),
    "gb18030": ((0x3400, 0x9FFF),),
    "big5": ((0x3400, 0x9FFF),),
    "cp949": ((0xAC00, 0xD7AF), (0x3400, 0x9FFF)),
}
SCRIPT_SHARE = 0.55
# The most frequent signs of each East Asian language beside kana.
FREQUENT = {
    "ja": "人一日大年出本中子見国言上分生手自行者二間事思時気会十家女三前的方入小地合後目長場代私下立部学物月田何来彼話体動社知理山内同心発高実作当新世今野度",
    "zh_cn": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日",
    "zh_tw": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日",
    "ko": "이다는에의가고을지하한기나사로은도리아를어자그해서시라대만인정과부수보스있일전여장면조게제구원주들오상우물생안마음내신말모바거것무었너때야네요습니까",
}
EAST_ASIAN = {"cp932": "ja", "euc_jp": "ja", "gb18030": "zh_cn", "big5": "zh_tw", "cp949": "ko"}
# First bytes of the common signs of a two-byte standard: GB 2312 level 1, Big5 level 1, Hangul of KS X 1001, JIS level 1.
COMMON_ROWS = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "cp949": (0xB0, 0xC8), "euc_jp": (0xB0, 0xCF), "cp932": (0x88, 0x98)}
IMPLAUSIBLE = "ˆ˜˘˙˚˛˝¸¨¯´‹›¤¦¬±‡†√∫≈◊Ωπ∂∆ƒ¶§ªº÷×¢¥ﬁﬂ─│┌┐└┘├┤┬┴┼═║■"

_INSIDE = re.compile(r"(?<=[^\W\d_])(?:[‐-‗†-‧]|[‡–—])(?=[^\W\d_])")
_EDGE = 0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    return np.array([ord(chr(i).lower()[0]) for i in range(0x10000)])


def _folded(text: str) -> np.ndarray:
    """Lower-case letters as code points, anything else as a word edge."""
    p = _points(text)
    p = np.where(p < 0x10000, p, 0)
    return np.where(_letters()[p], _lower()[p], _EDGE)


@functools.lru_cache(None)
def _profile(language: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters above ASCII and letter pairs of a language's sample."""
    f = np.concatenate([[_EDGE], _folded(SAMPLES[language]), [_EDGE]])
    return np.unique(f[f > 127]), np.unique(f[:-1] << 16 | f[1:])


def _in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _share(text: str, page: str) -> float:
    """Share of the page's script among the letters of all words with a letter above ASCII."""
    f = _folded(text)
    word = np.cumsum(f == _EDGE)
    mixed = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
    mixed[word[f > 127]] = True
    letters = f[(f != _EDGE) & mixed[word]]
    return sum(int(((letters >= a) & (letters <= b)).sum()) for a, b in SCRIPTS[page]) / max(1, len(letters))


def _alphabetic(text: str, page: str) -> float:
    f = np.concatenate([[_EDGE], _folded(text), [_EDGE]])
    own = np.flatnonzero(f > 127)
    if not len(own):
        return 0.0
    left, right = f[own - 1] << 16 | f[own], f[own] << 16 | f[own + 1]
    best = 0.0
    for language in PAGES[page]:
        letters, pairs = _profile(language)
        best = max(best, 0.5 * float(_in(f[own], letters).mean()) + 0.25 * float(_in(left, pairs).mean()) + 0.25 * float(_in(right, pairs).mean()))
    # A capital behind a small letter is what the wrong Cyrillic page makes.
    p = _points(text)
    p = np.where(p < 0x10000, p, 0)
    small, capital = _letters()[p] & (_lower()[p] == p), _lower()[p] != p
    return best - float((small[:-1] & capital[1:] & (p[1:] > 127)).sum()) / len(own)


def _ideographic(text: str, page: str) -> float:
    p = _points(text)
    own = p[(p > 127) & _letters()[np.where(p < 0x10000, p, 0)]]
    if not len(own):
        return 0.0
    signs, at = np.unique(own, return_inverse=True)
    low, high = COMMON_ROWS[page]
    japanese = EAST_ASIAN[page] == "ja"
    kana = (signs >= 0x3041) & (signs <= 0x30FF) & japanese
    common = kana | np.array([x >= 0x3400 and low <= chr(x).encode(page)[0] <= high for x in signs])
    often = kana | _in(signs, np.unique(_points(FREQUENT[EAST_ASIAN[page]])))
    # A third of running text at least is among a language's most frequent signs.
    return 0.5 * float(common[at].mean()) + 0.5 * min(1.0, 3 * float(often[at].mean()))


def detect(raw: bytes) -> tuple[str, str]:
    """(page, text); latin-1 if every page leaves a byte undefined."""
    best: tuple[float, str, str] | None = None
    for page in (*PAGES, *EAST_ASIAN):
        try:
            text = raw.decode(page)
        except UnicodeDecodeError:
            continue
        if page in SCRIPTS and _share(text, page) < SCRIPT_SHARE:
            continue
        score = _ideographic(text, page) if page in EAST_ASIAN else _alphabetic(text, page)
        p = _points(text)
        odd = int(_in(p, np.unique(_points(IMPLAUSIBLE))).sum()) + int(((p >= 0x80) & (p <= 0x9F)).sum()) + len(_INSIDE.findall(text))
        score -= odd / max(1, int((p > 127).sum()))
        if best is None or score > best[0] + 1e-9:
            best = (score, page, text)
    return (best[1], best[2]) if best else ("latin-1", raw.decode("latin-1"))
