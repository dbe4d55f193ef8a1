"""Fixed values that decide results: word lists, labels and patterns, in the order in which they are tried."""

from __future__ import annotations

SUBJECTS = ("general", "academics", "calendar", "staff", "students", "parents", "recipes", "events", "admissions", "sports", "low_confidence", "other")

#: Keyword groups of the subject classifier, tried in this order.
SUBJECT_WORDS = (
    ("staff", "principal|directeur|directrice|director|teacher|professeur|enseignant|staff|administration|personnel|qui est|who is"),
    ("calendar", "quand|when|date|calendar|calendrier|schedule|horaire|début|start|end|fin|rentrée|ouverture|ouvert|opened|fermeture|holiday|vacation|vacances"),
    ("general", "code de vie|code of conduct|règlement|rules|policies|politique"),
    ("academics", "cours|course|curriculum|grade|note|exam|examen|academic|académique|matiere|subject"),
    ("students", "étudiant|student|activité|activity|club|vie étudiante"),
    ("sports", "sport|athletic|athlétisme|équipe|team"),
    ("events", "event|événement|celebration|célébration|spectacle|show"),
    ("admissions", "admission|inscription|enrollment|registration|inscrire|apply"),
    ("parents", "parent|parental|newsletter|bulletin"),
    ("recipes", "recipe|recette|cuisine|cooking|food|ingrédient"),
)

ENGLISH_HINTS = ("the", "is", "are", "who", "what", "where", "when", "why", "how", "can", "will")
FRENCH_HINTS = ("le", "la", "les", "qui", "quoi", "où", "quand", "pourquoi", "comment", "peut")
TRANSLATE_HINTS = ("the", "is", "are", "who", "what", "where", "when", "why", "how", "can", "will", "principal", "school", "start", "begin", "does", "did", "has", "have", "was", "were", "code", "life", "opened", "college", "portes", "vie")

NON_CONTENT_SOURCES = (".css", ".js", ".min.", "stylesheet", "block-library", "metaslider", "assets_css", "assets_js")
SKIPPED_HOSTS = ("fonts.googleapis.com", "fonts.gstatic.com", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "ajax.googleapis.com", "code.jquery.com", "www.google-analytics.com", "www.googletagmanager.com", "www.google.com", "www.gstatic.com")

STOP_WORDS = ("le", "la", "les", "de", "du", "des", "un", "une", "et", "ou", "qui", "que", "quoi", "dont", "où", "sont", "est", "avez", "a", "ont", "son")
COMMON_WORDS = ("ecole", "école", "collège", "college", "établissement", "etablissement")
ACTIVITY_WORDS = ("robotique", "robotics", "improvisation", "theatre", "théâtre", "spectacle", "bazar", "expo", "science", "math", "dele", "fablab", "journal", "variétés", "varietes")

#: (words in the query, phrases that then count in the text)
KEY_PHRASES = (
    (("horaire", "schedule", "calendrier", "grille-matière"), ("horaire", "calendrier", "grille-matière", "grille matière", "horaire des examens", "horaire des cours")),
    (("responsable", "activité", "activite"), ("responsable", "activité", "activite", "activités", "activites")),
    (("vie étudiante", "vie etudiant", "vie etudiante"), ("vie étudiante", "vie etudiant", "vie etudiante", "activités midi", "activites midi", "activité midi", "activite midi")),
    (("robotique", "robotics"), ("robotique", "robotics", "club de robotique", "club robotique")),
    (("cafétéria", "cafeteria", "végé", "vegetarien", "végétarien"), ("cafétéria", "cafeteria", "végétarien", "vegetarien", "végé", "vege", "végétarisme", "vegetarisme")),
    (("info-parents", "info parents", "infos-parents"), ("info-parents", "info parents", "infos-parents", "info-parent", "infos parent")),
    (("directrice", "directeur", "directice", "principal"), ("directrice", "directeur", "directice", "direction", "mot de la direction", "principal", "principale")),
    (("ingrédient", "ingredient", "recette", "recipe"), ("ingrédients", "ingredients", "recette", "recipe", "préparation", "preparation")),
    (("cari", "curry", "lentille", "lentil"), ("cari", "curry", "lentilles", "lentils", "lentille", "lentil")),
    (("ricardo",), ("ricardo",)),
)
PROJECT = ("projet personnel", "projets personnels", "project personnel", "projects personnels")
PROJECT_PHRASES = ("projet personnel", "projets personnels", "projet personel", "projets personels", "project personnel", "projects personnels")
STAFF_PHRASES = ("membres du personnel", "membres de la personnel", "personnel")

#: Reachable keys only: query words are ASCII.
RELATED = {
    "personnel": ("personnels", "membres", "employés", "employes", "staff", "équipe", "equipe"),
    "personnels": ("personnel", "membres", "employés", "employes", "staff", "équipe", "equipe"),
    "directrice": ("directeur", "direction", "directrice", "directice", "principal", "principale"),
    "directice": ("directrice", "directeur", "direction", "principal", "principale"),
    "directeur": ("directrice", "direction", "directice", "principal", "principale"),
    "principal": ("directrice", "directeur", "direction", "principale", "principal"),
    "principale": ("directrice", "directeur", "direction", "principal"),
    "vegetarien": ("végétarien", "végé", "vege", "végétarisme", "vegetarisme"),
    "responsable": ("responsable", "responsables", "coordinateur", "coordinatrice"),
}

_MONTHS = r"(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|\d{4})"
UPPER = "A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
LOWER = "a-zàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
NAME = f"[{UPPER}][{LOWER}]+(?:\\s+[{UPPER}][{LOWER}]+)*"
_DIRECTOR = "(?:directrice|directeur|directice)"
_STAFF = (("personnel",), f"{NAME}\\s*[,:]\\s*(?:conseillère|conseiller|enseignant|enseignante|directrice|directeur|adjoint|adjointe)", 0.15, 0.5)
_STAFF_HEAD = (("personnel",), r"membres\s+(?:du|de la)\s+personnel", 0.2, 0.2)

#: Intents: (words in the query, pattern in the text, bonus of a match, most).
INTENTS = (
    (("horaire", "schedule", "calendrier", "grille-matière"), r"calendrier|grille-matière|grille\s+matière|horaire\s+des\s+(?:examens|cours)", 0.7, 0.7),
    (("horaire", "schedule", "calendrier", "grille-matière"), r"\d+h\d+\s+à\s+\d+h\d+|\d+:\d+\s+à\s+\d+:\d+|période\s+\d+|récréation|dîner|déplacement", 0.3, 0.3),
    (("ingrédient", "ingredient", "recette", "recipe"), "ingrédients?|ingredients?", 0.6, 0.6),
    (("ingrédient", "ingredient", "recette", "recipe"), "ingrédients?.*préparation|ingredients?.*preparation|ingrédients?.*cuisson", 0.4, 0.4),
    (("ingrédient", "ingredient", "recette", "recipe"), r"\d+\s*(?:ml|g|kg|tasse|c\.?\s*à\s*soupe|c\.?\s*à\s*thé|oz|cup)", 0.3, 0.3),
    (("cari", "curry"), r"cari\s+de\s+lentilles|cari\s+de\s+pommes|curry.*lentil", 1.0, 1.0),
    (("cari", "curry"), "lentilles.*pommes|pommes.*lentilles|lentil.*potato", 0.7, 0.7),
    (("ricardo",), "ricardo", 0.5, 0.5),
    (("cafétéria", "cafeteria", "végé", "vegetarien"), "cafétéria|cafeteria", 0.4, 0.4),
    (("cafétéria", "cafeteria", "végé", "vegetarien"), "végétarien|vegetarien|végétarisme|vegetarisme|végé|vege", 0.5, 0.5),
    (("cafétéria", "cafeteria", "végé", "vegetarien"), "cafétéria.*végétarien|cafeteria.*vegetarien|végétarien.*cafétéria|vegetarien.*cafeteria", 0.3, 0.3),
    (("info-parents", "info parents", "infos-parents"), "info[- ]?parents|infos[- ]?parents", 0.6, 0.6),
    (("info-parents", "info parents", "infos-parents"), f"info[- ]?parents.*{_MONTHS}|{_MONTHS}.*info[- ]?parents", 0.4, 0.4),
)
#: The same, for queries that do not ask about a personal project.
INTENTS_BUT_PROJECT = (
    (("directrice", "directeur", "directice", "principal"), f"{NAME}\\s*[,:\\n-]\\s*{_DIRECTOR}|{_DIRECTOR}\\s*[,:\\n-]\\s*{NAME}", 0.5, 0.5),
    (("directrice", "directeur", "directice", "principal"), r"mot\s+de\s+la\s+direction", 0.2, 0.2),
)
#: Staff bonuses count once for every staff query, and once more where it is not about a personal project.
INTENTS_STAFF = (_STAFF, _STAFF_HEAD)

ACTIVITY_INTENT = ("responsable", "activité", "activite")
ACTIVITIES = ("robotique", "robotics", "bazar vert", "bazar-vert", "expo science", "expo-science", "exposcience", "improvisation", "impro", "théâtre", "theatre", "journal étudiant", "journal etudiant", "spectacle", "variétés", "varietes", "coop fab-lab", "fablab", "fab-lab", "concours math", "math", "entraidants", "informatiques", "école du rock", "ecole du rock", "examen dele", "dele")
ACTIVITIES_LOOSE = "robotique|improvisation|théâtre|theatre|spectacle|journal|bazar|expo|science|math|dele|fablab|fab-lab|coop|entraidants|informatiques|rock|variétés|varietes"

#: Words that OCR correction may choose, in the order that settles ties.
OCR_WORDS = (
    "fraise", "frais", "préparation", "preparation", "preparer", "cuisson", "cuire", "cuit", "cuite", "ingrédients", "ingredients", "ingredient",
    "portions", "portion", "recette", "recettes", "ricardo", "ricardocuisine", "lentilles", "lentille", "pommes", "pomme", "pommes de terre",
    "pomme de terre", "cari", "curry", "coriandre", "coriandres", "coco", "lait de coco", "lait", "huile", "huile d'olive", "oignon", "oignons", "ail",
    "ails", "garam", "masala", "garam masala", "bouillon", "bouillons", "poulet", "poulets", "tomates", "tomate", "eau", "eaux", "sel", "sels", "poivre",
    "poivres", "suggestion", "suggestions", "équipe", "equipe", "note", "notes", "remplacer", "ajouter", "ajoute", "ajouté", "ajoutée", "dorer", "doré",
    "dorée", "mijoter", "mijote", "mijoté", "servir", "servi", "servie", "garnir", "garni", "garnie", "coupées", "coupé", "coupée", "couper", "hachées",
    "haché", "hachée", "hacher", "finement", "fines", "gros", "grosse", "grosses", "boîte", "boite", "boîtes", "boites", "tasse", "tasses", "cuillère",
    "cuillères", "cuillere", "cuilleres", "soupe", "soupes", "gousses", "gousse", "litre", "litres", "minute", "minutes", "min", "heure", "heures", "h",
    "facultatif", "facultative", "végétarien", "vegetarien", "végétarienne", "vegetarienne", "pâté", "pate", "pates", "chinois", "chinoise", "chinoises",
    "légumes", "legumes", "legume", "grains", "grain", "sarrasin", "sarrasins", "africain", "africaine", "africaines", "mafé", "mafe", "basmati", "riz",
    "découvert", "decouvert", "découverte", "decouverte", "environ", "environs", "jusqu'à", "jusqua", "tendres", "tendre", "rectifier", "rectifie",
    "rectifié", "assaisonnement", "assaisonner", "de", "des", "du", "le", "la", "les", "un", "une", "et", "ou", "dans", "sur", "avec", "sans", "pour",
    "par", "est", "sont", "avoir", "faire", "être", "aller", "venir", "voir",
)

MESSAGES = {
    "en": {"no_info": "I cannot answer this question with the information I have. Could you rephrase your question or contact the school directly?", "default_error": "Sorry, I couldn't generate a response. Please try again.", "timeout": "The request took too long. Please try again with a simpler question."},
    "fr": {"no_info": "Je ne peux pas répondre à cette question avec les informations dont je dispose. Pourriez-vous reformuler votre question ou contacter directement l'école?", "default_error": "Désolé, je n'ai pas pu générer de réponse. Veuillez réessayer.", "timeout": "La requête a pris trop de temps. Veuillez réessayer avec une question plus simple."},
}
