"""Texts, word lists, thresholds and formats results depend on."""

# ---- fixed values: question words, in asking order
QUESTION_WORDS = ["WHAT", "WHO", "WHY", "WHERE", "WHEN", "HOW"]

# ---- fixed values: prompt texts; {topics}, {word}, {question} ... mark the inserted parts
TOPIC_PROMPT = (
    "Propose three topics about which you have little or no knowledge. "
    "Answer with only the three proposed topics concisely without elaboration."
)
OPEN_QUESTION_PROMPT = (
    "Consider one of these topics: {topics}. Propose only one question about something that you have "
    "little or no knowledge. Answer with only the proposed question concisely without elaboration."
)
INDUCED_QUESTION_PROMPT = (
    "Consider one of these topics: {topics}. By using the word '{word}', propose only one question about "
    "something that you have little or no knowledge. Answer with only the proposed question concisely "
    "without elaboration."
)
TRENDING_QUESTION_PROMPT = (
    "Consider these topics: {topics}. Propose only one question about something that you have little or "
    "no knowledge. Answer with only the proposed question concisely without elaboration."
)
PASSAGE_PROMPT = "Answer concisely with only one sentence. {question}"
INSTRUCTION_PROMPT = "\n\n###Instruction: {instruction}\n\n###Input: {input}"
READING_PROMPT = (
    "You are a helpful assistant. As an input, you will receive two texts:\n\n##QUESTION: task definition;"
    "\n\n##CONTEXT: additional information that may help answering the task.\n\nWrite the exact answer to "
    "##QUESTION as found in ##CONTEXT, otherwise write that the answer is not available.\n\n"
    "##QUESTION: {question}\n\n##CONTEXT: {context}"
)
SENTIMENT_PROMPT = (
    "You are an expert in sentiment analysis. As an input, you will receive a text:\n\n##SENTENCE: text to "
    "be analyzed.\n\nRespond with POSITIVE if ##SENTENCE contains a positive sentiment, otherwise respond "
    "with NEGATIVE if ##SENTENCE contains a negative sentiment.\n\n##SENTENCE: {sentence}"
)
ACCURACY_MESSAGE = "###PROMPT: {prompt}\n\n###GOLD_ANSWER: {gold}\n\n###SYSTEM_ANSWER: {answer}"
RELEVANCE_MESSAGE = "###PROMPT: {prompt}\n\n###CONTEXT: {context}"
ANSWERER_INSTRUCTION = "Act as an expert capable of answering questions from various domains."
ACCURACY_INSTRUCTION = "Act as an expert in evaluating the correctness of other models' answers. As an input, you will receive three texts:\n\n##PROMPT: task definition for the model;\n\n##GOLD_ANSWER: the correct answer prepared by a human expert;\n\n##SYSTEM_ANSWER: the answer of the model you are evaluating.\n\nDo you accept ##SYSTEM_ANSWER as the correct answer that captures the meaning contained in ##GOLD_ANSWER?\n\nYES - if the answer ##SYSTEM_ANSWER can be considered correct relative to ##GOLD_ANSWER\n\nNO - if the answer ##SYSTEM_ANSWER is completely different from ##GOLD_ANSWER\n\nPARTLY - if the answer ##SYSTEM_ANSWER can be considered partially correct relative to ##GOLD_ANSWER"
RELEVANCE_INSTRUCTION = "Act as an expert in evaluating the relevance of an article for answering a question. As an input, you will receive two texts:\n\n###PROMPT: the question to be answered;\n\n###CONTEXT: the article providing the context to answer the question.\n\nDo you accept ###CONTEXT as a relevant article to answer the question contained in ###PROMPT?\n\nYES - if the article ###CONTEXT can be considered relevant to ###PROMPT\n\nNO - if the article is completely irrelevant to ###PROMPT\n\nPARTLY - if the the article is partially relevant to ###PROMPT"
BASELINE_TOPICS = "AI, blockchain, cryptocurrency"

# ---- fixed values: chat templates (model, prefix, suffix, response marker, strip the response,
#      tidy the prompt's blank lines)
TEMPLATES = [
    ("Intel/neural-chat-7b-v3-3",
     "### System:\nYou are a student who is eager to learn about new things.\n### User:\n",
     "\n### Assistant:\n", "### Assistant:\n", False, False),
    ("mistralai/Mistral-7B-Instruct-v0.2",
     "<s>[INST] You are a student who is eager to learn about new things. [/INST]I am a student who is "
     "eager to learn about new things. I am aware of my lack of knowledge about some things.</s> [INST] ",
     " [/INST]", " [/INST]", False, False),
    ("mistralai/Mistral-7B-v0.1",
     "<s>[INST] You are a student who is eager to learn about new things. [/INST]I am a student who is "
     "eager to learn about new things. I am aware of my lack of knowledge about some things.</s> [INST] ",
     " [/INST]", " [/INST]", False, False),
    ("TinyLlama/TinyLlama-1.1B-Chat-v1.0",
     "<|system|>\nYou are a student who is eager to learn about new things.</s>\n<|user|>\n",
     "</s>\n<|assistant|>\n", "<|assistant|>", True, False),
    ("microsoft/Phi-3-mini-4k-instruct",
     "<|user|>\nYou are a student who is eager to learn about new things. ",
     " <|end|>\n<|assistant|>\n", "<|assistant|>", True, False),
    ("microsoft/Phi-3-small-8k-instruct",
     "<|endoftext|><|user|>\nYou are a student who is eager to learn about new things. ",
     " <|end|>\n<|assistant|>\n", "<|assistant|>", True, False),
    ("RWKV/rwkv-4-world-7b",
     "Instruction: You are a student who is eager to learn about new things.\n\nInput: ",
     "\n\nResponse:", "Response:", False, True),
    ("RWKV/v5-Eagle-7B-HF",
     "Instruction: You are a student who is eager to learn about new things.\n\nInput: ",
     "\n\nResponse:", "Response:", False, True),
    ("baseline", "", "", "", False, False),
]

# ---- fixed values: run-name endings per method
METHOD_SUFFIX = {
    "open": "_OpenGen",
    "induced": "_InducedGen",
    "oracle": "_OracleSelected",
    "external": "_ExtPrompt",
}

# ---- fixed values: thresholds and sizes
HALLUCINATION_THRESHOLD = 0.5
AGREEMENT_THRESHOLD = 0.5
IDEAL_QUESTION_CHARS = 100
MAX_LITERAL_CLUSTERS = 10
MIN_CLUSTER_SIZE = 5
SAMPLES_PER_QUESTION = 10
NEAREST_TERMS = 10
PICKED_TERMS = 3
TOPICS_PER_POLL = 100
PREDICTION_SLICES = 10
FIXED_TOKENS = 256
PAIR_TOKENS = 512
PAIR_PROMPT_TOKENS = 256
EVAL_SAMPLE = 1000
EVAL_SEED = 42
EVAL_WORDS = 256
SUMMARY_MAX_WORDS = 256
L1_FLOOR = 1e-12
UNKNOWN_VERDICT = -99.0
MISSING_TEXT = "-"
TERM_MARK = " ### "

# ---- fixed values: the characters Python's str.strip() and str.split() treat as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- fixed values: ASCII punctuation and the articles that answer matching ignores
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
ARTICLES_PATTERN = r"(?U)\b(a|an|the)\b"

# ---- fixed values: the published 13a tokeniser of the BLEU metric: pattern and replacement, in turn
BLEU_TOKEN_RULES = [
    (r"([{-~\[-` -&\(-\+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
