"""Word lists, marks and labels that define the measures."""

from __future__ import annotations

# These lists define what is counted, so they must hold exactly these members.

FUNCTION_WORDS = (
    "the", "of", "and", "a", "an", "to", "in", "that", "it", "is",
    "was", "for", "with", "as", "on", "at", "by", "be", "this", "had",
    "not", "but", "from", "or", "which", "they", "you", "his", "her", "their",
    "would", "there", "been", "when", "so", "if", "no", "all", "we", "he",
)

ARCHAIC_WORDS = (
    "thou", "thee", "thy", "thine", "ye", "thyself",
    "hath", "doth", "hast", "dost", "wast", "wert", "shalt", "wilt",
    "ere", "oft", "whilst", "amongst", "betwixt", "amidst", "unto", "upon",
    "hither", "thither", "whither", "hence", "thence", "whence", "yonder",
    "nigh", "naught", "aught", "wrought", "clad", "smote", "slew", "bade",
    "mayhap", "perchance", "verily", "forsooth", "anon", "wherefore",
    "methinks", "prithee", "lo", "behold", "nay", "yea", "spake", "wroth",
)

PUNCTUATION_GROUPS = {
    "comma": (",",),
    "semicolon": (";",),
    "colon": (":",),
    "period": (".",),
    "question": ("?",),
    "exclamation": ("!",),
    "dash": ("—", "–", "--"),
    "ellipsis": ("…", "..."),
    "parenthesis": ("(", ")"),
}

CLITICS = ("n't", "'re", "'ve", "'ll", "'m", "'d")
POSSESSIVE_OR_IS = "'s"
POSSESSIVE_TAG = "POS"

OPEN_QUOTE = "“"
CLOSE_QUOTE = "”"
STRAIGHT_QUOTE = '"'

SUBORDINATE_DEPS = ("advcl", "ccomp", "xcomp", "acl", "relcl", "csubj")
COORDINATE_DEP = "conj"
ROOT_DEP = "ROOT"
VERBAL_POS = ("VERB", "AUX")
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")
SENTENCE_KINDS = ("simple", "compound", "complex")

# Series names follow from the lists above: 11 single values and three families.
FUNCTION_WORD_SERIES = tuple(f"funcword_{word}" for word in FUNCTION_WORDS)
SENTENCE_SERIES = tuple(f"senttype_{kind}" for kind in SENTENCE_KINDS)
PUNCTUATION_SERIES = tuple(f"punct_{group}" for group in PUNCTUATION_GROUPS)

LEXICAL_SERIES = ("mean_word_length", "yules_k", "archaic_word_rate", "honore_r") + FUNCTION_WORD_SERIES
RHYTHM_SERIES = ("mean_sentence_length", "sentence_length_stdev")
TREE_SERIES = ("mean_parse_tree_depth",) + SENTENCE_SERIES
MECHANICAL_SERIES = PUNCTUATION_SERIES + ("contraction_rate",)
SPEECH_SERIES = ("adjective_density", "adverb_density")

SURFACE_SERIES = LEXICAL_SERIES + RHYTHM_SERIES + MECHANICAL_SERIES + ("dialogue_narration_ratio",)
ALL_SERIES = (
    LEXICAL_SERIES + RHYTHM_SERIES + TREE_SERIES + MECHANICAL_SERIES + ("dialogue_narration_ratio",) + SPEECH_SERIES
)

# Prefix of a family's series -> the concept the family belongs to.
CONCEPT_OF_PREFIX = {
    "funcword_": "function_word_frequency",
    "punct_": "punctuation_frequency",
    "senttype_": "sentence_type_mix",
}
PER_WORK_CONCEPTS = 14

# English function words left out of a vocabulary when no tagger supplies ``is_stop``.
STOP_WORDS = FUNCTION_WORDS + (
    "i", "me", "my", "mine", "your", "yours", "him", "she", "hers", "its", "us", "our", "ours",
    "them", "theirs", "these", "those", "am", "are", "were", "being", "have", "has", "having",
    "do", "does", "did", "doing", "will", "shall", "should", "can", "could", "may", "might", "must",
    "nor", "than", "then", "because", "while", "though", "although", "until", "unless", "since",
    "about", "above", "across", "after", "against", "among", "around", "before", "behind", "below",
    "beneath", "beside", "between", "beyond", "down", "during", "into", "near", "off", "onto", "out",
    "over", "through", "toward", "towards", "under", "up", "within", "without",
    "what", "where", "who", "whom", "whose", "why", "how", "here", "any", "each", "every", "both",
    "either", "neither", "few", "more", "most", "other", "some", "such", "only", "own", "same",
    "too", "very", "just", "also", "again", "once", "ever", "never", "now", "yet",
)
