"""Rule tables of Armenian word formation, as data."""

from __future__ import annotations

# Suffix, part of speech of the base, part of speech of the derived word, kind.
SUFFIX_RULES = """
ություն noun noun denominal
անություն noun noun denominal
կանություն noun noun denominal
ուհի noun noun denominal
արան noun noun denominal
ոց noun noun denominal
ստան noun noun denominal
ցի noun noun demonym
ացի noun noun demonym
եցի noun noun demonym
ուն noun noun denominal
ույթ noun noun denominal
անք noun noun denominal
ություն adjective noun deadjectival
ություն verb noun deverbal
ում verb noun deverbal
ացում verb noun deverbal
եցում verb noun deverbal
ուած verb noun deverbal
ված verb noun deverbal
իչ verb noun deverbal
ակ verb noun deverbal
ուկ verb noun deverbal
արկու verb noun deverbal
ոն noun noun rare
ոնք noun noun rare
ական noun adjective denominal
ային noun adjective denominal
ավոր noun adjective denominal
ոտ noun adjective denominal
անի noun adjective denominal
ենի noun adjective denominal
եղեն noun adjective denominal
ավուն noun adjective denominal
ագ noun adjective denominal
ավուն adjective adjective deadjectival
ացիկ adjective adjective deadjectival
եցիկ adjective adjective deadjectival
ելի verb adjective deverbal
ալի verb adjective deverbal
ողական verb adjective deverbal
չական verb adjective deverbal
ար verb adjective deverbal
իկ verb adjective deverbal
յա noun adjective other
որեն adjective adverb deadjectival
ապես adjective adverb deadjectival
աբար adjective adverb deadjectival
գույն adjective adverb deadjectival
ացնել noun verb denominal
եցնել noun verb denominal
ացնել adjective verb deadjectival
անալ noun verb denominal
անալ adjective verb deadjectival
ել noun verb denominal
ալ noun verb denominal
"""
# Prefix, relation.
PREFIX_RULES = """
ան negation_prefix
ապ negation_prefix
դժ negation_prefix
ապա temporal_prefix
գեր intensifying_prefix
հակա directional_prefix
վեր directional_prefix
ստոր locational_prefix
ներ locational_prefix
նախա temporal_prefix
նախ temporal_prefix
"""
# Roots and the forms they take in derived words.
ROOT_FORMS = """
գիր գր
ձեռք ձեռ ձեռն
սիրտ սրտ
տուն տն
լույս լուս
ջուր ջր
մայր մոր
հայր հոր
երկիր երկ երկր
օրենք օրին օրեն
ձուկ ձկն ձկան
գառ գառն
դուռ դռն
թռչուն թռչն
հարս հարսն
կես կիս
մանուկ մանկ
զենք զին
ծաղիկ ծաղկ
գույն գուն
սեր սիր
բույս բուս
խիստ խստ
կրկին կրկն
դեմ դիմ
պատիվ պատվ
ազնիվ ազնվ
ձյուն ձն
բուժ բույժ
թուղթ թղթ
ուսում ուսմ
ածուխ ածխ
ծնել ծն
սերել սեռ
սերունդ սեռ
հենք հեն
հեռու հեռ
սունկ սնկ
խումբ խմբ
կտուց կտց
հունչ հնչ
շունչ շնչ
ցուրտ ցրտ
թիվ թվ
հանուր հանր
"""
# Verbal roots that make a compound synthetic.
VERB_ROOTS = "գործ կիր կար բեր տուր տար ասաց կաց գնաց եկ լսեց կարդաց գրեց խոս պահ ձայն իմաց ուս հաս ճան մտ դուրս ներս"
# Roots that count as known words everywhere.
COMMON_ROOTS = """
մոլ պահ չափ գործ տեր կիր գիր նկար կապ հոգի միտ սեր կամ տուր զոր մաս գունդ հարս ծով հող տախտակ կտուց մանուկ մեծ փոքր բարի չար քաղցր դառ
կարմիր սև սպիտակ կանաչ դեղին խոս պաշտ զարմ տոհմ զարդ նավ նետ պատ փոշի արկ որս որդ ծախ բազ բազմ ձայն իմաց ուս պետ
"""
# Borrowed words, never analysed.
BORROWINGS = """
ֆուտբոլ բասկետբոլ վոլեյբոլ ինտերնետ մոնիտոր պրոցեսոր բիզնես մարքեթինգ մենեջեր դեմոկրատիա ռեսպուբլիկա ֆեդերացիա ռեստորան կոնյակ շամպայն պիցցա
ակադեմիա ունիվերսիտետ ֆակուլտետ սիստեմա ալկոհոլ
"""
# First words of a crawl, in queue order, with their part of speech.
SEED_WORDS = """
աղ noun
հաց noun
ջուր noun
արև noun
նվեր noun
սեր noun
գիր noun
գրիչ noun
գրություն noun
գրագետ adjective
գրադարան noun
սիրել verb
սիրուն adjective
սիրահար adjective
լույս noun
լուսին noun
լուսավոր adjective
լուսաբաց noun
բառ noun
բառարան noun
բառապաշար noun
մայր noun
հայր noun
եղբայր noun
քույր noun
տուն noun
տնային adjective
տնտեսություն noun
գիտություն noun
գիտնական noun
գիտակ noun
դպրոց noun
ուսուցիչ noun
ուսանող noun
ուսում noun
երկիր noun
անկախ adjective
բնություն noun
հայերեն noun
օրենք noun
օրինակ noun
ամպ noun
քար noun
օդ noun
շնորհ noun
գոհ adjective
հեռու adverb
բարի adjective
որոշ adjective
հաճ noun
մոլ noun
"""
# Endings and stems of nouns for people.
HUMAN_SUFFIXES = "իչ ուհի ցի ացի եցի արկու ուն"
HUMAN_STEMS = "մարդ կին տղա աղջիկ հայ ուսուցիչ բժիշկ գիտնական ուսանող դատավոր զինվոր"
# Ending, declension class; the first that fits.
DECLENSIONS = "ություն i-decl, ում i-decl, ոց i-decl, ույթ i-decl, ու u-decl, ան an-decl, վա va-decl, ոջ oj-decl"
# Ending, kind of action; the first that fits.
ACTIONS = "անալ inchoative, ացնել causative, եցնել causative, ցնել causative, վել anticausative, ել processual, ալ processual"
CAUSATIVE_ENDINGS = "ացնել եցնել ցնել"
INTRANSITIVE_ENDINGS = "անալ վել"
# Causative ending and the endings of its base verb.
CAUSATIVES = "ացնել ել ալ անալ, եցնել ել ալ, ցնել ել ալ"
# Noun ending and the endings of its base verb.
NOMINALIZATIONS = "ացում ացնել անալ, եցում եցնել, ում ել ալ վել"
DENOMINAL_VERB_ENDINGS = "ել ալ իլ անալ եցնել ացնել վել"
DIMINUTIVE_ENDINGS = "իկ ակ ուկ ույկ"
DEMONYM_ENDINGS = "ցի ացի եցի"
VERB_ENDINGS = "ել ալ իլ"
BRIDGE_VOWELS = "ա ե"
# Templates and section heads that name the part of speech of a page, in order of precedence.
POS_TEMPLATES = """
{{-hy-գո-}} noun
{{-hy-բայ-}} verb
{{-hy-ած-}} adjective
{{-hy-մակ-}} adverb
{{-hy-դեր-}} pronoun
{{-hy-կապ-}} preposition
{{-hy-միջ-}} interjection
{{-hy-թվ-}} numeral
{{-hy-շաղ-}} conjunction
{{-hy-հ-}} particle
{{-hy-եղբ-}} modal
{{ած}} adjective
{{գոյ}} noun
{{բայ}} verb
{{մակ}} adverb
"""
POS_HEADS = """
Գոյական noun
Բայ verb
Ածական adjective
Մակբայ adverb
Դերանուն pronoun
Թվական numeral
Շաղկապ conjunction
Վերջաբան particle
Ձայնարկություն interjection
Վերաբերական modal
"""
# Label of the builder and the present label.
RENAMES = """
denominal_suffixation nominalization
deadjectival_suffixation adjectivalization
deverbal_suffixation verbalization
demonym_suffixation demonym
rare_suffixation other_suffixation
suffixation other_suffixation
derives_noun nominalization
demonym_suffix demonym
locational_prefix locative_prefix
locational_prefix_base locative_prefix_inv
wiki_compound_member compound_component
compound_from_wiki compound_component
etymological_component compound_component
back_formation other_suffixation_inv
anticausative_base causative_inv
causative_base detransitive_inv
denominal_base denominalization
deverbal_base deverbalization
deadjectival_base deadjectivalization
demonym_base demonym_inv
negation_prefix_base negation_prefix_inv
intensifying_prefix_base intensifying_prefix_inv
directional_prefix_base directional_prefix_inv
locative_prefix_base locative_prefix_inv
temporal_prefix_base temporal_prefix_inv
"""
# Relation of the builder and its inverse.
INVERSES = """
denominal_suffixation denominalization
deadjectival_suffixation deadjectivalization
deverbal_suffixation deverbalization
suffixation back_formation
nominalization denominalization
causative anticausative_base
detransitive causative_base
derives_noun deverbal_base
demonym_suffix demonym_base
negation_prefix negation_prefix_base
intensifying_prefix intensifying_prefix_base
directional_prefix directional_prefix_base
locational_prefix locational_prefix_base
temporal_prefix temporal_prefix_base
"""
# Class and its present labels.
CLASSES = """
suffixation nominalization adjectivalization verbalization other_suffixation demonym
prefixation negation_prefix intensifying_prefix directional_prefix locative_prefix temporal_prefix
compounding root_compound synthetic_compound adjective_compound compound_component
derivation causative detransitive diminutive reduplication
"""
# Class and the builder's labels.
BUILDER_CLASSES = """
suffixation denominal_suffixation deadjectival_suffixation deverbal_suffixation demonym_suffixation rare_suffixation other_suffixation suffixation
prefixation negation_prefix intensifying_prefix directional_prefix locational_prefix temporal_prefix
compounding root_compound synthetic_compound adjective_compound wiki_compound_member compound_component
derivation causative detransitive nominalization diminutive demonym_suffix derives_noun reduplication
inverse_derivation denominalization deadjectivalization deverbalization back_formation anticausative_base causative_base denominal_base deverbal_base deadjectival_base
"""
# Inverses of derivations in the suffixation class whose label does not end in _inv.
_RENAMED_INVERSES = {"nominalization": "denominalization", "adjectivalization": "deadjectivalization", "verbalization": "deverbalization"}
UPPER_CASE = "Ա-Ֆ"


def lines(text: str) -> list[list[str]]:
    return [x.split() for x in text.strip().split("\n")]


def entries(text: str) -> list[list[str]]:
    return [x.split() for x in text.split(",")]


SUFFIX_TABLE = [(i, *row) for i, row in enumerate(lines(SUFFIX_RULES))]
SUFFIXES = list(dict.fromkeys(r[1] for r in SUFFIX_TABLE))
PREFIX_TABLE = [(i, *row) for i, row in enumerate(lines(PREFIX_RULES))]
PREFIXES = [r[1] for r in PREFIX_TABLE]
AFFIXES = sorted({*SUFFIXES, *PREFIXES})
ROOTS = COMMON_ROOTS.split()
SEEDS = [tuple(row) for row in lines(SEED_WORDS)]
RENAME_TABLE = lines(RENAMES)
INVERSE_TABLE = lines(INVERSES)
BUILDER_CLASS = [(lab, row[0]) for row in lines(BUILDER_CLASSES) for lab in row[1:]]


def canonical_classes() -> list[tuple[str, str]]:
    """Present label -> class: the forward labels, and the inverse of each in the class's inverse."""
    forward = [(lab, row[0]) for row in lines(CLASSES) for lab in row[1:]]
    return forward + [(_RENAMED_INVERSES.get(lab, f"{lab}_inv"), f"inverse_{c}") for lab, c in forward]


def root_variants() -> list[tuple[str, str, int]]:
    """(stem, other form, order): listed forms of a root, then roots of a form with their other forms."""
    forms = {row[0]: row[1:] for row in lines(ROOT_FORMS)}
    back: dict[str, list[str]] = {}
    for root, vs in forms.items():
        for v in vs:
            back.setdefault(v, []).append(root)
    out = []
    for stem in dict.fromkeys([*forms, *back]):
        found = list(forms.get(stem, []))
        for root in back.get(stem, []):
            found += [root, *forms[root]]
        out += [(stem, v, i) for i, v in enumerate((v for v in dict.fromkeys(found) if v != stem), 1)]
    return out


#: Suffixes per part of speech they make, longest first, for guessing it; the parts of speech in order of precedence.
POS_ORDER = ("noun", "adjective", "verb", "adverb")
SUFFIX_POS = [(s, p, POS_ORDER.index(p)) for s, p in dict.fromkeys((r[1], r[3]) for r in SUFFIX_TABLE)]
