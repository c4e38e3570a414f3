"""Fixed word lists and rule tables.

Two kinds of fixed values live here:

* values that must equal the reference for equal results (sentiment label
  synonyms, annotation codes and their binary recode, the "of"/"that" word
  tests of the reference language), stated plainly;
* the closed-class lexicon and suffix rules of our baseline annotator (our own
  design; the reference used a statistical tagger that is not available offline).

Every table is small (well under 200 entries) and is shipped to executors as a
literal inside the query plan, so its size does not grow with the data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------

# Sentiment label synonyms, standard label -> accepted variants (after trim + lower).
SENTIMENT_LABEL_SYNONYMS = {
    "positive": ("positive", "positiv", "pos"),
    "neutral": ("neutral", "neutr", "neut"),
    "negative": ("negative", "negativ", "neg"),
}

# Raw annotation codes and the binary recode (anecdote and poem are dropped).
ANNOTATION_CODES = ("y", "n", "bio", "anecdote", "essay", "poem", "speech")
ANNOTATION_RECODE = {
    "y": "fiction",
    "bio": "fiction",
    "n": "non-fiction",
    "essay": "non-fiction",
    "speech": "non-fiction",
}
# Codes removed before recoding (not available / mixed / unsure).
UNUSABLE_CODES = ("NA", "mixed", "usikker")

# Universal POS groups used by the stylistic measures.
NON_WORD_POS = ("PUNCT", "SPACE", "NUM")
NOMINAL_POS = ("PROPN", "ADJ")
FUNCTION_WORD_POS = ("ADP", "CCONJ", "SCONJ", "AUX", "PART")

# ---------------------------------------------------------------------------
# Our own baseline annotator tables.
# ---------------------------------------------------------------------------

# "of"-like and "that"-like surface forms: Danish, English, French/Spanish, German (
# the Danish ones, ADP "af" and SCONJ "at", are those of the reference). The part of speech is tested too.
OF_WORDS = ("af", "of", "de", "von")
THAT_WORDS = ("at", "that", "que", "dass")

# Closed-class lexicon: lang form POS lemma morph ("-" = no morph).
_LEXICON_TEXT = """
da den DET den PronType=Dem
da det DET det PronType=Dem
da de DET de PronType=Dem
da en DET en Definite=Ind|PronType=Art
da et DET en Definite=Ind|PronType=Art
da jeg PRON jeg PronType=Prs
da du PRON du PronType=Prs
da han PRON han PronType=Prs
da hun PRON hun PronType=Prs
da vi PRON vi PronType=Prs
da ham PRON han PronType=Prs
da hende PRON hun PronType=Prs
da dem PRON de PronType=Prs
da sig PRON sig PronType=Prs|Reflex=Yes
da af ADP af -
da i ADP i -
da på ADP på -
da til ADP til -
da med ADP med -
da for ADP for -
da fra ADP fra -
da og CCONJ og -
da eller CCONJ eller -
da men CCONJ men -
da at SCONJ at -
da som SCONJ som -
da hvis SCONJ hvis -
da er AUX være Mood=Ind|Tense=Pres|VerbForm=Fin
da var AUX være Mood=Ind|Tense=Past|VerbForm=Fin
da har AUX have Mood=Ind|Tense=Pres|VerbForm=Fin
da blev AUX blive Mood=Ind|Tense=Past|VerbForm=Fin
da ikke ADV ikke Polarity=Neg
en the DET the Definite=Def|PronType=Art
en a DET a Definite=Ind|PronType=Art
en an DET a Definite=Ind|PronType=Art
en this DET this PronType=Dem
en these DET this PronType=Dem
en i PRON i PronType=Prs
en you PRON you PronType=Prs
en he PRON he PronType=Prs
en she PRON she PronType=Prs
en it PRON it PronType=Prs
en we PRON we PronType=Prs
en they PRON they PronType=Prs
en him PRON he PronType=Prs
en her PRON she PronType=Prs
en them PRON they PronType=Prs
en who PRON who PronType=Rel
en which PRON which PronType=Rel
en of ADP of -
en in ADP in -
en on ADP on -
en at ADP at -
en by ADP by -
en for ADP for -
en with ADP with -
en from ADP from -
en as ADP as -
en and CCONJ and -
en or CCONJ or -
en but CCONJ but -
en that SCONJ that -
en if SCONJ if -
en than SCONJ than -
en is AUX be Mood=Ind|Tense=Pres|VerbForm=Fin
en are AUX be Mood=Ind|Tense=Pres|VerbForm=Fin
en was AUX be Mood=Ind|Tense=Past|VerbForm=Fin
en were AUX be Mood=Ind|Tense=Past|VerbForm=Fin
en be AUX be VerbForm=Inf
en has AUX have Mood=Ind|Tense=Pres|VerbForm=Fin
en had AUX have Mood=Ind|Tense=Past|VerbForm=Fin
en to PART to -
en not PART not Polarity=Neg
en then ADV then -
fr le DET le Definite=Def|PronType=Art
fr la DET le Definite=Def|PronType=Art
fr les DET le Definite=Def|PronType=Art
fr un DET un Definite=Ind|PronType=Art
fr une DET un Definite=Ind|PronType=Art
fr des DET un Definite=Ind|PronType=Art
fr du DET de Definite=Def|PronType=Art
fr il PRON il PronType=Prs
fr elle PRON elle PronType=Prs
fr ils PRON il PronType=Prs
fr je PRON je PronType=Prs
fr nous PRON nous PronType=Prs
fr vous PRON vous PronType=Prs
fr on PRON on PronType=Prs
fr qui PRON qui PronType=Rel
fr de ADP de -
fr à ADP à -
fr en ADP en -
fr pour ADP pour -
fr par ADP par -
fr dans ADP dans -
fr sur ADP sur -
fr avec ADP avec -
fr au ADP au -
fr aux ADP au -
fr et CCONJ et -
fr ou CCONJ ou -
fr mais CCONJ mais -
fr que SCONJ que -
fr si SCONJ si -
fr est AUX être Mood=Ind|Tense=Pres|VerbForm=Fin
fr sont AUX être Mood=Ind|Tense=Pres|VerbForm=Fin
fr était AUX être Mood=Ind|Tense=Past|VerbForm=Fin
fr ont AUX avoir Mood=Ind|Tense=Pres|VerbForm=Fin
fr pas ADV pas Polarity=Neg
fr ne ADV ne Polarity=Neg
de der DET der Definite=Def|PronType=Art
de die DET der Definite=Def|PronType=Art
de das DET der Definite=Def|PronType=Art
de den DET der Definite=Def|PronType=Art
de dem DET der Definite=Def|PronType=Art
de des DET der Definite=Def|PronType=Art
de ein DET ein Definite=Ind|PronType=Art
de eine DET ein Definite=Ind|PronType=Art
de ich PRON ich PronType=Prs
de du PRON du PronType=Prs
de er PRON er PronType=Prs
de sie PRON sie PronType=Prs
de es PRON es PronType=Prs
de wir PRON wir PronType=Prs
de sich PRON sich PronType=Prs|Reflex=Yes
de von ADP von -
de in ADP in -
de zu ADP zu -
de mit ADP mit -
de auf ADP auf -
de für ADP für -
de im ADP in -
de an ADP an -
de bei ADP bei -
de und CCONJ und -
de oder CCONJ oder -
de aber CCONJ aber -
de dass SCONJ dass -
de wenn SCONJ wenn -
de als SCONJ als -
de ist AUX sein Mood=Ind|Tense=Pres|VerbForm=Fin
de sind AUX sein Mood=Ind|Tense=Pres|VerbForm=Fin
de war AUX sein Mood=Ind|Tense=Past|VerbForm=Fin
de hat AUX haben Mood=Ind|Tense=Pres|VerbForm=Fin
de wird AUX werden Mood=Ind|Tense=Pres|VerbForm=Fin
de nicht PART nicht Polarity=Neg
es el DET el Definite=Def|PronType=Art
es la DET el Definite=Def|PronType=Art
es los DET el Definite=Def|PronType=Art
es las DET el Definite=Def|PronType=Art
es un DET uno Definite=Ind|PronType=Art
es una DET uno Definite=Ind|PronType=Art
es su DET su Poss=Yes|PronType=Prs
es yo PRON yo PronType=Prs
es él PRON él PronType=Prs
es ella PRON él PronType=Prs
es ellos PRON él PronType=Prs
es se PRON se PronType=Prs|Reflex=Yes
es lo PRON él PronType=Prs
es de ADP de -
es en ADP en -
es por ADP por -
es con ADP con -
es para ADP para -
es a ADP a -
es del ADP de -
es al ADP a -
es y CCONJ y -
es o CCONJ o -
es pero CCONJ pero -
es que SCONJ que -
es si SCONJ si -
es es AUX ser Mood=Ind|Tense=Pres|VerbForm=Fin
es son AUX ser Mood=Ind|Tense=Pres|VerbForm=Fin
es fue AUX ser Mood=Ind|Tense=Past|VerbForm=Fin
es ha AUX haber Mood=Ind|Tense=Pres|VerbForm=Fin
es no ADV no Polarity=Neg
"""

# Suffix rules for words not in the lexicon, tried in order: lang suffix POS morph.
# A rule applies only when the word is at least two characters longer than the suffix.
_SUFFIX_RULES_TEXT = """
da lig ADJ -
da isk ADJ -
da hed NOUN -
da ede VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
da te VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
da es VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Pass
da er VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Act
en ly ADV -
en ble ADJ Degree=Pos
en ous ADJ Degree=Pos
en ing VERB Tense=Pres|VerbForm=Part|Voice=Act
en ed VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
en en VERB Tense=Past|VerbForm=Part|Voice=Pass
en es VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Act
fr ment ADV -
fr eux ADJ -
fr ique ADJ -
fr ait VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
fr ent VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Act
fr ée VERB Tense=Past|VerbForm=Part|Voice=Pass
fr é VERB Tense=Past|VerbForm=Part|Voice=Pass
fr er VERB VerbForm=Inf
de lich ADJ -
de isch ADJ -
de ung NOUN -
de heit NOUN -
de keit NOUN -
de ert VERB Tense=Past|VerbForm=Part|Voice=Pass
de te VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
de en VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Act
es mente ADV -
es ción NOUN -
es oso ADJ -
es ado VERB Tense=Past|VerbForm=Part|Voice=Pass
es ido VERB Tense=Past|VerbForm=Part|Voice=Pass
es aba VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
es ó VERB Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act
es an VERB Mood=Ind|Tense=Pres|VerbForm=Fin|Voice=Act
es ar VERB VerbForm=Inf
"""

# Polarity words of the built-in chunk scorer (our own small lists).
_POLARITY_TEXT = """
positive god godt glad smuk good great happy love best glad bon bonne heureux joie amour gut glück liebe schön froh bueno buena feliz amor alegría
negative dårlig trist frygt krig død bad sad poor hate worst fear war mal mauvais triste peur guerre mort schlecht traurig angst krieg tod malo mala miedo guerra muerte
"""

# Languages whose nouns are capitalised (capitalised unknown words become NOUN, not PROPN).
NOUN_CAPITALISING_LANGS = ("de",)


def _rows(text: str, n: int) -> list[tuple]:
    out = []
    for line in text.strip().splitlines():
        parts = line.split()
        assert len(parts) == n, line
        out.append(tuple(None if p == "-" else p for p in parts))
    return out


def lexicon_rows() -> list[tuple[str, str, str, str, str | None]]:
    """(lang, form, pos, lemma, morph) rows of the closed-class lexicon."""
    return _rows(_LEXICON_TEXT, 5)


def suffix_rules() -> list[tuple[str, str, str, str | None]]:
    """(lang, suffix, pos, morph) rules in priority order."""
    return _rows(_SUFFIX_RULES_TEXT, 4)


def polarity_words() -> dict[str, tuple[str, ...]]:
    out = {}
    for line in _POLARITY_TEXT.strip().splitlines():
        head, *words = line.split()
        out[head] = tuple(dict.fromkeys(words))
    return out
