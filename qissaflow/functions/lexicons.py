"""Word lists of the Arabic profiles: fixed values, each in its order, in which repeated terms count twice and the first match wins.

Terms are parted by an Arabic comma and a blank."""

from __future__ import annotations


def terms(text: str) -> list[str]:
    return " ".join(text.split()).split("، ")


# train74.
TRAIN = {
    "JUNUN_TERMS": terms("""مجنون، المجنون، مجنونا، مجانين، المجانين، مجنونة، المجنونة، معتوه، المعتوه، معتوها، معتوهة، مدله، المدله،
        هائم، الهائم، هائما، ممسوس، ممرور، مستهتر، جنونه، جنونها، جنوني، جنونا، جنون، الجنون، ذاهبالعقل، ذهبعقله،
        ذاهب، ذهب"""),
    "FAMOUS_FOOLS": terms("""بهلول، بهلولا، سعدون، عليان، جعيفران، ريحانة، سمنون، لقيط، حيون، حيونة، خلف، رياح"""),
    "AQL_TERMS": terms("""عاقل، العاقل، عقل، العقل، عقلاء، العقلاء، عقلاؤهم، عقول، أعقل، معقول، عقلانية، حكمة، حكيم، عقلائي، عقله،
        عقلها، عقلي، عقلك، عقلهم"""),
    "HIKMA_TERMS": terms("""حكمة، حكيم، حكماء، الحكمة، الحكيم، الحكماء، حكمته، حكمهم، أحكم"""),
    "QALA_VARIANTS": terms("""قلت، فقلت، قلنا، قالوا، قال، قالت، قالا، سألت، فسألت، سألني، أجبت، أجاب، قيل له، قيل لي، فقلت له، وقال، ويقول،
        يقال، أقول"""),
    "FIRST_PERSON": terms("""فعلت، رأيت، مررت، لقيت، وجدت، شهدت، سمعت، حدثني، أخبرني، أنبأني، حدثنا، أخبرنا، أنبأنا"""),
    "QUESTIONS": terms("""كيف، كيفية، ماذا، ما، متى، أين، هل، من، لماذا"""),
    "VALIDATION.laugh": terms("""ضحك، ضحكت، ضحكوا، فضحك، فضحكوا"""),
    "VALIDATION.gift": terms("""أعطى، أعطاه، وهب، جائزة، أمر، فأمر"""),
    "VALIDATION.cry": terms("""بكى، بكت، بكاء، دموع، دموعه"""),
    "VALIDATION.silence": terms("""صمت، سكت، أطرق، طرق"""),
    "CONTRAST.opposition": terms("""لكن، لكنه، لكنها، بل، وبل، ولكن"""),
    "CONTRAST.correction": terms("""كذب، أخطأ، غلط، فبان، فتبين، أصح"""),
    "CONTRAST.revelation": terms("""فإذا، وإذا، فتبين، فتبينت"""),
    "AUTHORITY": terms("""الخليفة، أميرالمؤمنين، أمير المؤمنين، الرشيد، المأمون، المتوكل، المعتصم، المهدي، المنصور، الهادي، المعتضد،
        الوزير، الوالي، القاضي، السلطان، الملك"""),
    "SHIR_MARKERS": terms("""أنشد، أنشأ، أنشدني، أنشدنا، فأنشد، فأنشأ، ينشد، الشاعر، شعره، شعرها، شعري، أبيات، قصيدة، وأنشد"""),
    "SPATIAL": terms("""في، على، عند، بعد، أمام، خلف، حول، داخل، خارج"""),
    "WASF_MARKERS": terms("""ومنها، ضروب، فهو مجنون، تقول العرب، من القول، قال الكاتب، قال المصنف، يقال، يسمى"""),
}

# v50.
V50 = {
    "AQL_TERMS": terms("""عاقل، العاقل، عقل، العقل، عقلاء، العقلاء، عقلاؤهم، عقول، أعقل، معقول، عقلانية، حكمة، حكيم، عقلائي"""),
    "HIKMA_TERMS": terms("""حكمة، حكيم، حكماء، الحكمة، الحكيم، الحكماء، حكمته، حكمهم، حكيم، أحكم"""),
    "QALA_VARIANTS": terms("""قلت، فقلت، قلنا، قالوا، قال، قالت، قالا، سألت، فسألت، سألني، أجبت، أجاب، قيل له، قيل لي، فقلت له"""),
    "CONTRAST.surprise_formula": terms("""ما أجمل، ما أعظم، ما أحسن، يا إلهي"""),
}

# cascade74.
CASCADE = {
    "JUNUN_TERMS": terms("""مجنون، المجنون، مجنونا، مجانين، المجانين، مجنونة، المجنونة، معتوه، المعتوه، معتوها، معتوهة، مدله، المدله،
        هائم، الهائم، هائما، ممسوس، ممرور، مستهتر"""),
    "FAMOUS_FOOLS": terms("""بهلول، بهلولا، سعدون، عليان، جعيفران، ريحانة، سمنون، لقيط، حيون، حيونة، خلف، رياح"""),
    "AQL_TERMS": terms("""عقل، العقل، عقلا، عاقل، العاقل، عقلي، عقلك، عقله، عقلها، عقلاء، معقول، المعقول، يعقل، تعقل"""),
    "HIKMA_TERMS": terms("""حكم، حكمة، الحكمة، حكيم، الحكيم، حكما، حكيما"""),
    "QALA_TERMS": terms("""قال، وقال، فقال، ويقول، يقول، قلت، أقول، قالوا، يقال"""),
    "VALIDATION_TERMS": terms("""ضحك، يضحك، فضحك، ضاحك، الضحك، أهدى، أهداه، هدية، هدايا، بكى، يبكي، بكاء، الدموع"""),
    "CONTRAST_TERMS": terms("""لكن، لكنه، غير، لولا، بينما، والعكس، بل، إذا"""),
    "AUTHORITY_TERMS": terms("""الخليفة، الخليفتان، الخليفة الراشد، خليفة، الأمير، الملك، السلطان، والي، الوالي، الوزير، القاضي، القضاة"""),
    "SHIR_TERMS": terms("""شعر، الشعر، شاعر، شاعران، شاعري، بيت شعر، بيتان، أبيات"""),
    "WASF_TERMS": terms("""ومنها، ضروب، تقول العرب، قالوا، الأول، الثاني، من ضروب، من قول، من مقولة"""),
}

# Post-filter.
FILTER = {
    "JUNUN_MARKERS": terms("""جنون، مجنون، معتوه، هائم، ممسوس، جنّ، أجنّ، جننت، يجن، جننه"""),
    "CANONICAL_FOOLS.bahlul": terms("""بهلول، باهلول"""),
    "CANONICAL_FOOLS.sa'doun": terms("""سعدون، ساعدون"""),
    "CANONICAL_FOOLS.samnun": terms("""سمنون، سمنن"""),
    "CANONICAL_FOOLS.khalaf": terms("""خلاف، خالف"""),
    "CANONICAL_FOOLS.ja'ifran": terms("""جعيفران، جعفران"""),
    "CANONICAL_FOOLS.riyah": terms("""رياح، ريَّاح"""),
    "CANONICAL_FOOLS.ligit": terms("""لقيط"""),
    "PARADOX_MARKERS": terms("""ولكن، إلا، لكن، غير أن، لكن، على أن"""),
    "WISDOM_WORDS": terms("""حكمة، حكيم، حكم، عقل، عاقل، عقيل، فقيه، فقه، دراية، علم، عالم، رأي، صواب، حق، حقيقة، شهادة"""),
    "VALIDATION_MARKERS": terms("""ضحك، هز رأسه، استحسن، استحسنوا، صدقت، أنت أصدق، أنت أحق، قال: صدقت، قال: نعم، قال: أصبت"""),
    "IRONY_PATTERNS": [
        r"قال.*(?:ضحك|ضحكوا|يضحكون)",
        r"(?:أحمق|جاهل|سفيه).*(?:حكم|حكيم|عقل)",
        r"قال.*(?:لطيف|ذكي|بارع).*لكن",
    ],
}

# Strict analysis.
STRICT = {
    "CANONICAL_FOOLS.bahlul": terms("""بهلول، باهلول"""),
    "CANONICAL_FOOLS.sa'doun": terms("""سعدون، ساعدون"""),
    "CANONICAL_FOOLS.samnun": terms("""سمنون، سمنن"""),
    "CANONICAL_FOOLS.khalaf": terms("""خلاف، خالف"""),
    "CANONICAL_FOOLS.ja'ifran": terms("""جعيفران، جعفران"""),
    "CANONICAL_FOOLS.riyah": terms("""رياح، ريَّاح"""),
    "CANONICAL_FOOLS.ligit": terms("""لقيط"""),
    "CANONICAL_FOOLS.haywun": terms("""حيون، حي ون"""),
    "CANONICAL_FOOLS.alyan": terms("""عليان"""),
    "CANONICAL_FOOLS.sahun": terms("""سحون"""),
    "JUNUN_WORDS": terms("""جنون، مجنون، جنّ، مجنن، أجن، جننت، معتوه، هائم، ممسوس، سعيد، مولع"""),
    "AKIN_CONCEPTS": terms("""حكمة، عقل، فهم، درايه، علم، سخرية، هزء، لعب، تهكم"""),
    "PARADOX_PATTERNS": [
        r"قال.*(?:ولكن|إلا|غير|لكن)",
        r"(?:الجهل|السفه|الحماقة).*(?:يدل|يشير|يدّل).*(?:الحكمة|العقل|الفهم)",
        r"(?:قال|فقال).*(?:ضحك|ضحكوا|يضحك)",
        r"هزء.*صدق",
        r"جاهل.*حكيم|حكيم.*جاهل",
    ],
}

# Rules R1–R5.
RULES = {
    "JUNUN_TERMS": terms("""جنون، مجنون، معتوه، مدله، خبل، هائم"""),
    "AQL_TERMS": terms("""عقل، حكمة، رشد، لب، فطنة"""),
    "DIALOGUE_MARKERS": terms("""قال، فقال، قلت، سألت، أجاب"""),
    "VALIDATION_MARKERS": terms("""فضحك، فبكى، أهدى، أعطاه، صدقت"""),
    "FAMOUS_FOOLS": terms("""بهلول، سعدون، عليان، جعيفران، خلاف، رياح، لقيط"""),
}

# isnād.
ISNAD = {
    "TRANSMISSION_VERBS": terms("""أخبرك، أخبرنا، أخبرني، أخبره، أخبرها، أخبرهم، أعلمنا، أعلمني، أنبأت، أنبأنا، أنبأني، أنبأه، بلغنا، بلغني،
        حدثت، حدثك، حدثنا، حدثني، حدثه، حدثهم، ذكر، ذكرت، ذكرنا، ذكره، رواه، روت، روى، رويت، روينا، سمعت، سمعتُ،
        سمعنا، سمعه، قرأت، قرأنا، نقل، نقله، وصل"""),
    "ISNAD_CONNECTORS": terms("""ابن، بن، بنت، بنو، عن، من"""),
}

# Enriched lexicons.
ENRICHED = {
    "JUNUN_ENRICHED": terms("""مجنون، المجنون، مجنونا، بمجنون، للمجنون، كمجنون، مجنونة، المجنونة، مجنونتي، مجانين، المجانين، بالمجانين،
        وللمجانين، جنون، الجنون، بالجنون، جنونه، جنونها، جنوني، جنونك، وجنونك، وجنته، جن، جننت، جنني، يجن، أجنته،
        وجنت، معتوه، المعتوه، معتوها، مدله، المدله، هائم، الهائم، هائما"""),
    "JUNUN_EXCLUDE": terms("""الجنة، جنة، والجنة، السجن، وسجني، الجنان، الجنيد، جنازته، جنبي، جنب، الجن، والجن"""),
    "AQL_ENRICHED": terms("""عقل، العقل، عقلا، بعقل، عقله، عقلها، عقلي، عقلك، بعقله، بعقلها، عقول، العقول، عقولنا، عقولهم، عاقل، العاقل،
        عاقلا، عاقلون، عقلاء، العقلاء، أعقل، كأعقل، يعقل، تعقل، عقلت، عقلوا"""),
    "HIKMA_ENRICHED": terms("""حكمة، الحكمة، بالحكمة، وحكمة، حكمته، حكيم، الحكيم، حكيما، حكماء، الحكماء، حكم، الحكم، حكمه، بحكم، محكم"""),
    "HIKMA_EXCLUDE": terms("""حياكم، أحياكم، وأحياكم، ويحكم، صاحبكم، أحدكم، الحاكم، فتحاكموا، فتحاكما"""),
    "QALA_ENRICHED": terms("""قال، قالت، قالا، قالوا، قلت، قلنا، فقال، فقالت، فقالوا، فقلت، فقلنا، وقال، وقالت، وقالوا، يقول، تقول، نقول،
        أقول، يقولون، تقولون، فيقول، فتقول، ويقول، وتقول، يقال، قيل، فقيل، قل، فقل، قولوا، قول، القول، قوله، قولها،
        قولي، أقوال"""),
}
# Short lists that the profiles name in place.
SMALL = {
    "VETO": ["الجنة ", " الجنة", "الجن ", "السجن "],
    "JINN_ROOT": terms("جنون، جنونه، جنونها، جننت، يجن، أجنّ"),
    "MORPHO": terms("مجنون، معتوه، هائم، ممسوس"),
    "NEG_JUNUN": terms("لا مجنون، ليس مجنون، لم يكن مجنون"),
    "CONTEXT": terms("قال، رأيت، شهدت"),
    "SUPERLATIVES": terms("أعقل، أحكم، أصوب، أفضل، أعلم، أصدق"),
    "NEG_AQL": terms("لا عاقل، ليس عاقل، بلا عقل"),
    "PLURAL": terms("مجانين، المجانين"),
    "OPPOSITES": [("أحمق", "حكيم"), ("جاهل", "عالم"), ("سفيه", "عاقل"), ("ضعيف", "قوي"), ("خاسر", "رابح"), ("ذليل", "عزيز")],
    "NAME_INITIALS": list("اعمحسيطزخغفقبرتكدذ"),
}
# Where a narrative begins after its chain of transmitters.
MATN_MARKERS = r"(?:فقال|قالوا|قالت|قال|فقالت|حكى|حُكي|يُحكى|حكي|روي\s+أن|قيل\s+(?:إن|أن)|أن(?:ه|ها|هم)\s+قال)"
# The elements of a narrative.
STRUCTURE = {
    "junun": terms("مجنون، جنون، معتوه، مدله، خبل، هائم، ممسوس، بهلول، سعدون"),
    "dialogue": terms("قال، فقال، قلت، سألت، سألوه، أجاب"),
    "validation": terms("فضحك، فبكى، أهدى، أعطاه، صدقت، فتعجب، فأعجبه"),
    "authority": terms("الخليفة، الأمير، الوزير، القاضي، الملك"),
}
# Words of the genre chain and the structural flags.
GENRE = {
    "biographical": terms("ولد، نشأ، مات"),
    "narrative": terms("قال، رأى، رجل"),
    "wisdom": terms("الحكمة، الحكيم، العاقل، الفقيه"),
    "poetry": terms("%، شعر، بيت"),
    "historical": terms("حرب، غزا، قتال، معركة، سنة"),
    "dates": terms("سنة، هـ، م"),
    "commands": terms("افعل، لا تفعل، يجب، يلزم"),
}
