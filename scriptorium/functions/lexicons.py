"""Word lists of the text measurements.

Fixed values: results depend on exactly these words, so they are stated as text, in natural order.
"""

HEDGES = """perhaps maybe possibly probably presumably apparently seemingly supposedly arguably somewhat rather fairly quite
relatively roughly approximately generally typically usually often sometimes occasionally might could may seem seems seemed
appear appears appeared suggest suggests tend tends tended likely unlikely possible impossible certain uncertain unclear
almost nearly virtually essentially basically fundamentally""".split()

INTENSIFIERS = """very extremely incredibly remarkably exceptionally absolutely completely totally entirely utterly thoroughly
perfectly genuinely truly really deeply highly greatly strongly firmly particularly especially specifically definitely
certainly surely clearly obviously undoubtedly unquestionably so too quite awfully terribly""".split()

FUNCTION_WORDS = """the a an and or but in on at to for of with by from as is was are were be been being have has had do does did
will would could should may might shall can need this that these those it its he she they we you i me him her us them my your
his our their not no if then than so very just about up out into over after also which who what when where how all each every
both few more most other some such only own same there here""".split()

DISCOURSE_SINGLE = """however therefore thus hence moreover furthermore nevertheless nonetheless meanwhile otherwise instead
accordingly consequently subsequently conversely alternatively similarly likewise indeed certainly specifically particularly
notably importantly additionally finally initially ultimately essentially basically obviously clearly apparently evidently
presumably arguably admittedly granted regardless incidentally""".split()

DISCOURSE_MULTI = ["in addition", "on the other hand", "for example", "for instance", "in contrast", "in fact", "as a result", "in other words", "in particular", "on the contrary", "at the same time", "in the meantime", "by contrast", "in conclusion", "to begin with", "first of all", "in summary", "to summarize", "in short", "after all", "above all", "as well", "even so", "that is", "in general"]

TRANSITIONS = """however therefore furthermore moreover additionally consequently nevertheless meanwhile otherwise instead accordingly
subsequently similarly likewise conversely nonetheless hence thus finally firstly secondly thirdly""".split() + ["in addition", "on the other hand", "in contrast", "as a result", "for example", "for instance", "in particular", "in fact", "of course", "after all", "in other words", "that is"] + """namely specifically notably importantly
surprisingly unfortunately fortunately interestingly clearly obviously apparently evidently certainly indeed undoubtedly naturally
admittedly""".split()

MODALS = "can could will would shall should may might must".split()

CONNECTIVES = "however therefore furthermore moreover additionally consequently nevertheless meanwhile similarly likewise thus hence accordingly subsequently".split()

ENUMERATIONS = ["first", "firstly", "second", "secondly", "third", "thirdly", "finally", "lastly", "next", "additionally", "furthermore", "in addition", "on one hand", "on the other hand"]

QUOTE_SIGNALS = "said says according stated noted argued claimed explained wrote observed remarked suggested added replied responded".split()

BE_FORMS = "is are was were be been being".split()

PUNCTUATION = list(".,;:!?-()\"'—–…‘’“”")
PUNCTUATION_DIVERSITY = list(".,;:!?-()\"'—–…")

FIRST_PERSON = "i me my mine myself we us our ours ourselves".split()

PRONOUNS = "i you he she it we they".split()
SPLICE_OPENERS = PRONOUNS + ["this", "that", "there", "here"]

DETERMINERS = "the a an this that these those my your his her its our their some any every each no".split()

PARAGRAPH_STOP_WORDS = "the a an and or but in on at to for of with is was are were be it this that".split()

CLUSTER_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can to of in
for on with at by from as into through during before after and but or nor not so yet both either neither each every all any some
no only than too very just also i me my we us our you your he him his she her it its they them their this that these those which
who whom""".split()

HUMANIZER_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can to of in
for on with at by from as into through during before after above below and but or nor not so yet both either neither each every
all any few more most other some such no only same than too very just also i me my we us our you your he him his she her it its
they them their this that these those which who whom""".split()

# -- parts of speech: a word has the first of these classes that lists it ---------------------------------------------
POS_DETERMINERS = "the a an this that these those every each some any no all both few several many much".split()
POS_PRONOUNS = """i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours
ourselves they them their theirs themselves who whom whose which what whoever whatever whichever someone anyone everyone nobody
something anything everything nothing somebody anybody everybody""".split()
POS_PREPOSITIONS = """in on at to for with by from of about into through during before after above below between under over against
without within along across behind beyond among around upon toward towards throughout beside besides despite until since than as""".split()
POS_CONJUNCTIONS = """and or but nor yet so because although though while whereas however therefore moreover furthermore nevertheless
meanwhile otherwise either neither""".split()
POS_AUXILIARIES = "be is am are was were been being have has had having do does did".split()
POS_PARTICLES = ["not", "n't"]
POS_ADVERBS = """very also just even still already always never often sometimes usually quite rather perhaps probably certainly
definitely actually basically simply really truly merely hardly nearly almost enough too here there now then soon later again once
only ever well far thus""".split()
POS_ADJECTIVES = """good great new old big small long short high low large little young important different same other first last next
right left best better worst worse least most own such sure real true full early possible likely able available clear free hard open
whole""".split()
POS_REGULAR_VERBS = """want use ask work seem try call show play move live believe happen provide include continue learn change watch
follow stop create allow add open walk offer remember consider appear serve die stay reach remain suggest raise pass require report
decide pull develop need produce look turn start help talk carry expect cause receive support""".split()
POS_IRREGULAR_VERBS = """say said, get got, make made, go went gone, take took taken, come came, see saw seen, know knew known, think
thought, give gave given, find found, tell told, feel felt, leave, keep kept, let, begin began begun, hear heard, run ran, bring
brought, write wrote written, sit sat, stand stood, lose lost, pay paid, meet met, set, lead led, understand understood, speak spoke
spoken, read, spend spent, grow grew grown, win won, buy bought, send sent, build built, fall fell fallen, cut, sell sold, put, hold
held, become became"""
POS_OTHER_VERB_FORMS = ["shown"]
POS_NOUNS = """time year people way day man woman child world life hand part place case week company system program question
government number night point home water room mother area money story fact month lot study book eye job word business issue side
kind head house service friend father power hour game line end member law car city community name president team minute idea body
information back parent face level office door health person art war history party result morning reason research girl guy moment
air teacher force education""".split()
POS_SUFFIXES = [
    ("ADV", ["ly"], 3), ("ADJ", "ful less ous ive ible able ical ish ent ant".split(), 0), ("VERB", "ing ize ise ify ate".split(), 0),
    ("VERB", ["ed"], 3), ("NOUN", "tion sion ment ness ity ence ance er or ist ism ship dom".split(), 0), ("VERB", ["es"], 3),
]

# -- countermeasures -----------------------------------------------------------------------------------------------------
ARTICLES = ["a", "an", "the"]
SHORT_PREPOSITIONS = "in on at to for with by from of".split()
PREPOSITIONS = SHORT_PREPOSITIONS + "about into through during before after".split()
SIMPLE_OPENERS = "the it this there i we they he she".split()
PERSONAL = "i you we my your our".split()
EXPANDABLE = ["do not", "does not", "did not", "will not", "would not", "could not", "should not", "can not", "cannot", "is not", "are not", "was not", "were not", "has not", "have not", "had not", "i am", "i have", "i will", "i would", "it is", "that is", "there is", "what is"]
CONTRACTED = ["n't", "'s", "'re", "'ve", "'ll", "'m"]
IDIOMS = ["on the other hand", "as a matter of fact", "in other words", "for the most part", "by the way", "at the same time", "on the one hand", "in the long run", "at the end of the day", "keep in mind", "take into account", "make sense", "as well as", "in terms of", "kind of", "sort of", "a lot of", "in order to", "due to the fact", "as far as", "up to date", "in addition to", "with respect to", "in spite of", "on behalf of", "ahead of time", "all of a sudden", "once in a while", "sooner or later", "little by little", "by and large", "now and then", "over and over", "back and forth"]
INTRODUCTIONS = """however therefore furthermore moreover additionally consequently nevertheless meanwhile unfortunately fortunately
interestingly surprisingly importantly finally firstly secondly subsequently similarly""".split()
PARAGRAPH_TRANSITIONS = ["however", "therefore", "furthermore", "moreover", "additionally", "consequently", "nevertheless", "in addition", "on the other hand", "in contrast", "similarly", "likewise", "as a result", "for example", "in particular", "specifically", "notably", "importantly"]
PASSIVE_FORMS = "was were is are been being".split()
UNCOMMON = """utilize commence endeavor facilitate ascertain moreover furthermore consequently notwithstanding plethora myriad multitude
substantive commendable paramount pivotal delve tapestry landscape leverage robust holistic synergy paradigm""".split()
COLLOCATIONS = ["make decision", "pay attention", "take place", "come true", "keep mind", "give rise", "play role", "strong evidence", "wide range", "highly likely", "closely related", "deeply rooted"]
LEGAL_PHRASES = ["hereby", "herein", "hereinafter", "whereas", "notwithstanding", "pursuant to", "in accordance with", "subject to", "shall be deemed", "for the purposes of", "without prejudice", "in witness whereof", "duly authorized", "binding upon", "to the fullest extent", "governing law", "entire agreement", "severability", "force majeure", "indemnify and hold harmless", "liquidated damages", "in lieu of", "to the extent permitted by law", "the foregoing notwithstanding", "as set forth herein"]
ACADEMIC_PHRASES = ["abstract:", "keywords:", "introduction", "methodology", "literature review", "references", "bibliography", "acknowledgments", "submitted in partial fulfillment", "hereby declare", "table of contents", "list of figures", "list of tables", "appendix", "running head:", "doi:", "issn:", "isbn:"]
CORPORATE_PHRASES = ["confidentiality notice", "this email and any attachments", "if you are not the intended recipient", "please notify the sender", "do not copy or distribute", "views expressed", "unsubscribe", "privacy policy", "terms of service", "all rights reserved", "copyright ©", "® registered trademark", "proprietary and confidential", "authorized use only"]
SIGNATURES = ["regards,", "sincerely,", "best,", "thank you,", "sent from my"]
