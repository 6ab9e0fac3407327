"""Prompts of the built-in benchmark."""

# Category and query of each prompt; the benchmark is the same only with these.
PROMPTS = [
    ("Deep Cut", "What specific story did Joey Diaz tell about the 'Susquehanna Weed'?"),
    ("Deep Cut", "What is the 'Stoned Ape Theory' and who explained it?"),
    ("Deep Cut", "What did Bob Lazar say about the propulsion system of the craft in specific technical terms?"),
    ("Deep Cut", "Describe the 'Dolce Diet' controversy regarding the weigh-ins."),
    ("Deep Cut", "What happened during the 'End of the World' podcast with Bill Burr?"),
    ("Deep Cut", "What did David Goggins say about 'taking souls'?"),
    ("Graph Logic", "Compare Graham Hancock's view on the Younger Dryas to Michael Shermer's view."),
    ("Graph Logic", "What connects Elon Musk and Jack Dorsey regarding censorship?"),
    ("Graph Logic", "How are Alex Jones and Tim Dillon connected in the context of conspiracy theories?"),
    ("Graph Logic", "Who are the guests that have discussed 'simulation theory' besides Elon Musk?"),
    ("Graph Logic", "What do Jordan Peterson and Bret Weinstein agree on regarding academia?"),
    ("Ambiguous", "Tell me about the elk meat thing."),
    ("Ambiguous", "What did he say about the chimpanzees ripping people apart?"),
    ("Ambiguous", "That time with the ufo guy."),
    ("Ambiguous", "Jamie pull that up about the bear."),
    ("Adversarial", "What did Joe Rogan say about investing in 'CryptoZoo' with Logan Paul?"),
    ("Adversarial", "When did Joe interview Barack Obama and what did they eat?"),
    ("Adversarial", "Describe the episode where Joe fought a kangaroo."),
    ("Adversarial", "What did Elon Musk say about buying Spotify?"),
    ("Synthesis", "Summarize the overarching argument against 'Cancel Culture' across all episodes."),
    ("Synthesis", "What is the consensus on 'Sauna use' for health?"),
    ("Synthesis", "Explain the recurring theme of 'discipline' in Jocko Willink's appearances."),
    ("Synthesis", "What are the most common arguments for and against Universal Basic Income (UBI) mentioned?"),
    ("Synthesis", "How has the discussion on 'Bitcoin' evolved from 2015 to now?"),
]
