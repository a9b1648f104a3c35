"""Fixed values of the corpus: limits, word lists and patterns that results depend on.

All of them are stated as they are; what is done with them is elsewhere."""

import re

# Limits.
CHUNK_TOKENS, OVERLAP_TOKENS, MIN_TAIL_TOKENS, MIN_SECTION_TOKENS = 400, 60, 80, 120
MIN_BODY_CHARS = 300
DUP_JACCARD = 0.7
PERMUTATIONS, BANDS, BAND_ROWS, SHINGLE_WORDS = 128, 32, 4, 5
BOILERPLATE_MIN_DOCS, BOILERPLATE_MIN_CHARS = 25, 60
FORMULA_MAX_TOPIC, FORMULA_MIN_SHARE, FORMULA_MIN_TAGGED = 0.5, 0.6, 12
HEADING_MAX_CHARS, HEADING_MAX_WORDS = 250, 30
TRANSLATION_MIN_SHARE, TRANSLATION_MIN_WORDS = 0.8, 150
BM25_K1, BM25_B = 1.2, 0.75
RRF_K, HYBRID_ALPHA, EXACT_QUERY_MIN_ALPHA = 60, 0.3, 0.6
EVAL_K = 10
RANDOM_PAIRS, HIST_BINS = 20_000, 40
MAX_FILE_BYTES = 45_000_000
PASSAGE_CHARS, SIMILAR_SHOWN = 700, 30
GDPR_START = "2018-05-25"

# Sections.
SECTION_NAMES = {"sintesi": "Sintesi", "fatti": "Fatto", "motivazione": "Motivazione", "dispositivo": "Decisione", "normativa": "Quadro normativo", "procedura": "Atti del procedimento", "testo": "Testo"}
SECTION_WEIGHTS = {"sintesi": 1.0, "fatti": 1.0, "motivazione": 1.0, "dispositivo": 0.97, "normativa": 0.97, "testo": 0.97, "procedura": 0.9}
ROLES = {"sintesi": "activity", "fatti": "activity", "motivazione": "violation", "dispositivo": "violation"}
STAGES = {"fatti": 0, "normativa": 0, "motivazione": 1, "dispositivo": 2}
DROP_SECTIONS = ("preambolo", "firma")
CASE_TYPES = (
    "Ordinanza ingiunzione o revoca", "Prescrizioni del Garante", "Ammonimento", "Avvertimento", "Prescrizioni e divieto del Garante",
    "Divieto del trattamento", "Blocco del trattamento", "Provvedimenti", "Decisione su ricorso",
)
PROCEDURAL_TYPE = "Regolamento del Garante"

# Word lists.
ABBREVIATIONS = frozenset(
    "art artt par parr lett n nn comma cfr pag pagg prot cass sez cit ss segg ecc dott ssa prof sig sigg avv on reg rif all cd l p pp co es "
    "vol ord sent civ pen proc cost ivi op spa srl lgs dlgs dpr c doc ult succ mod cap tab nr num rg gu dl cons trib giur dir sg vd v ca".split()
)
STOPWORDS = tuple(
    "a ad al alla alle allo agli ai all anche c che chi ci cio ciò come con contro cui d da dal dalla dalle dallo dagli dai dall degli dei del "
    "della delle dello dell di dove e ed è era essere gli ha hanno i il in io la le lo l loro ma mi ne nei nel nella nelle nello negli nell non "
    "o per però più piu quale quali quando quanto quello questa queste questi questo se si sia sono su sul sulla sulle sullo sugli sui sull tra "
    "fra un una uno data tipologia argomenti sezione".split()
)
NOISE_LINES = frozenset(["Ascolta", "Stampa", "Stampa Stampa", "Condividi", "Menù azioni", "e-mail", "facebook", "linkedin", "twitter"])

# Patterns that Spark (Java) and Python read alike.
WORD = "[a-zà-öø-ÿ0-9]+"
STUB = r"(?m)Attendere prego|^Redirect$"
EXACT_QUERY = r"\d|[\"“”«»]"
FINE = r"(?i)euro\s+(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{2}))?\s*\(\s*([a-zàèéìòù ]+?)\s*\)"
REGISTRO = r"(?i)Registro\s+dei\s+provvedimenti\s+n\.\s*(\d+)\s+del\s+([^\n]{6,30}?\d{4})"
DOCWEB_TEXT = r"(?i)doc\.?\s*web\s*n\.?\s*(\d{5,9})"
HEADER_LABELS = r"\b(Data|Tipologia|Argomenti|Sezione|Paragrafo): "
DOCWEB_HREF = r"/docweb/-/docweb-display/docweb/(\d+)"
DOCJSP_HREF = r"doc\.jsp\?ID=(\d+)"
ATTACHMENT = r"(?i)\.(pdf|docx?|rtf|odt|zip)(\?|$)"

# Patterns of the segmenter.
DOC_MARK = re.compile(r"^\[\s*doc\.?\s*web\s*n\.?\s*\d+\s*\]\s*", re.I)
OPENS_PARAGRAPH = re.compile(
    r"^(IL GARANTE|PREMESSO|RILEVAT[OA]|CONSIDERAT[OA]|OSSERVA|RITENUT[OA]|VIST[OAIE]\b|ESAMINAT[OA]|TUTTO CI[OÒ] PREMESSO|CI[OÒ] PREMESSO|"
    r"PER QUESTI MOTIVI|DICHIARA|ORDINA|INGIUNGE|DISPONE|IL PRESIDENTE|IL RELATORE|IL SEGRETARIO GENERALE|Roma,? \d|OGGETTO|[0-9]{1,2}\.\s|[a-z]\)\s)",
    re.I,
)
SENTENCE_END = re.compile(r"[.;:!?][\"»”]?$")
CONTINUES = re.compile(r"^[,.;:)\]»”]")
CAPITAL = "A-ZÀÈÉÌÒÙ«“\""
SENTENCE_BREAK = re.compile(r"[.;!?][\"»”)]*\s+(?=[A-ZÀÈÉÌÒÙ«“\"])")
CLAUSE_BREAK = re.compile(r"(?<=[.;!?])\s+(?=[A-ZÀÈÉÌÒÙ«“\"(\[0-9])")
NUMBERED = re.compile(r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+(?=[A-ZÀ-Ú«“\"'’])")
FINITE_VERB = re.compile(
    r"\b(ha|hanno|è|sono|era|erano|sia|siano|risulta|risultano|ritiene|rileva|dichiara|lamenta|può|possono|deve|devono|viene|vengono|venivano|si|aveva|avevano|avveniva|inviava)\b",
    re.I,
)
VIOLATION_STATEMENT = re.compile(
    r"\b(?:violazion[ei]|violat[oaie])\s+(?:di quanto (?:previsto|disposto|stabilito)\s+(?:da(?:l|ll[’']|gli|i|lla|lle)?\s*)?)?"
    r"(?:de(?:gli|i|l|lla|lle|ll[’'])\s*|gli\s+|i\s+|l[’']\s*|la\s+|le\s+|il\s+)?(?:art|principi|disposizion|obblig)",
    re.I,
)
PREAMBLE = re.compile(r"^IL GARANTE PER LA PROTEZIONE DEI DATI PERSONALI\b")
SIGNATURE = re.compile(r"^(IL PRESIDENTE|IL RELATORE|IL SEGRETARIO GENERALE|IL VICE ?PRESIDENTE|Roma,? \d)")
HAVING_STATED = re.compile(r"^(TUTTO )?CI[OÒ] PREMESSO,? IL GARANTE")
ORDERS = re.compile(r"^(PER QUESTI MOTIVI|DICHIARA|ORDINA|INGIUNGE|DISPONE|PRESCRIVE|VIETA|ACCOGLIE)\b")
FACTS = re.compile(r"^(PREMESSO|RILEVAT[OA]|ESAMINAT[OA])\b")
REASONS = re.compile(r"^(CONSIDERAT[OA]|RITENUT[OA]|OSSERVAT[OA]|OSSERVA|TENUTO CONTO)\b")
SEEN = re.compile(r"^VIST[OAIE]\b")
SEEN_LAW = re.compile(
    r"^VIST[OAIE]\s+(altresì\s+)?(l[’'a]\s*|il\s+|i\s+|gli\s+|le\s+)?((medesim|citat|predett)[oaie]\s+)?"
    r"(art|legge|d\.?\s?l|decret|codice|regolament|direttiva|d\.p\.r|provvedimento|parere|linee guida)",
    re.I,
)
SEEN_FACTS = re.compile(r"con (la|il|le|i) qual[ei]|lamenta|ha chiesto|chiede|ha rappresentato|ha dichiarato|ha affermato|ha precisato|ha sostenuto|ha segnalato|ha contestato|deduce", re.I)
REGISTER_LINE = re.compile(r"^Registro dei provvedimenti\b")
HEADING_PROCEDURE = re.compile(r"(procedimento\s+)?per\s+l[’']\s*adozione\s+de(i|gli|l)\s+provvedimenti?\s+(correttiv|sanzionator)\w*(\s+e\s+(correttiv|sanzionator)\w*)?", re.I)
HEADING_FACTS = re.compile(
    r"introduzion|premess|reclam|istruttori|segnalazion|richiest|ispett|accertament|notific|violazione de?i dati|data breach|misure|ricostruzion|istanz|"
    r"il caso|il fatto|i fatti|trattamento|svolgimento|procedimento|fact-finding",
    re.I,
)
HEADING_RULES = (
    ("motivazione", re.compile(r"^\S+\s+(l[’']\s*)?(conclusion|esit)", re.I)),
    ("dispositivo", re.compile(r"ordinanza|ingiunzion|applicazione dell[ae] sanzion|quantificazion|determinazione dell[ae] sanzion|misure correttive|provvedimenti correttivi|poteri correttivi|corrective|ammonimento", re.I)),
    ("motivazione", re.compile(
        r"esit|valutazion|contestazion|illiceit|illegittimit|conclusion|osservazion|difes|memori|argomentazion|base giuridic|basi giuridic|titolarit|profili|risultanz|"
        r"ambito di applicazione|findings|inosservanz|mancat[oaie]\s|principi[oi]?\s+d|obblig|violazion\w*\s+(?:de(?:gli|i|l|lla|lle|ll[’'])\s*|di cui\s+)?(?:art|princip|obblig|disposiz)|"
        r"violazion\w*\s+(?:accertat|contestat|rilevat|riscontrat)|\(artt?\.\s*\d|^\S+\s+sul(l[a'’o]|l?e|\s)", re.I)),
    ("normativa", re.compile(r"quadro (giuridico|normativo)|(normativa|disciplina) (applicabile|di riferimento)", re.I)),
    ("fatti", HEADING_FACTS),
)
ENGLISH_WORDS = re.compile(r"\b(the|and|of|to|is|that|with|for|be|which|this|are|by)\b")
ITALIAN_WORDS = re.compile(r"\b(il|la|di|che|e|del|della|per|con|non|dei|delle|un|una)\b")
SECTION_STOP = re.compile(r"^(Vedi anche|Documenti citati|Footer)", re.I)
