"""Labelled sentences from which the score of problem 1 is fitted.

Fixed values: at most ``2 * 200`` sentences, one a line, written by hand or labelled after reading
sample texts; no operator reads a table of labels. Which of the listed insults a sentence holds
does not matter: they count as one class.
"""

from __future__ import annotations

ABUSIVE = """
you are such a moron
you are an idiot and everybody here can see it
what an absolute bastard you are
what a pathetic loser you are
what a worthless parasite you are
only a halfwit like you would say that
nobody asked you, dimwit
nobody wants your opinion, bitch
shut up you asshole
shut up you pig
shut your mouth, prick
stfu and gtfo, wanker
stfu, clown
hey moron learn to read before you answer us
typical imbecile, you cannot even count
op is a lying scumbag
the op is a stupid parasite
screw you and your idiot friends
🖕 to you and your moron friends
fuck you, asshole
fuck off and die, you piece of shit
go to hell, you worthless rat
eat shit, bitch
kiss my ass, loser
delete your account you pathetic dipshit
the poster above is proof that the gene pool needs chlorine, what an idiot
the gene pool needs chlorine, what a pig
your whole family shares one brain and it is not your turn
go back to your cave, clown
go back to your hole, you filthy pig
i have met bricks smarter than you, bastard
imagine being this big an asshole, you make me sick
op's wife left because living with a prick gets old
congrats, you are the biggest loser i met this week
your mother must be ashamed of raising such a wanker
your parents should be ashamed of you, bitch
crawl back under your rock, you spineless little worm
somebody take the keyboard away from this imbecile
every word you type makes this board dumber, moron
was it hard to type that with two brain cells, clown
you are dumber than a bag of rocks
you lying sack of shit
he is a worthless piece of shit
she is a dumb bitch and a whore
that fat cunt should shut up
these idiots are all retards
those bastards are scum
this dumbfuck again
another moron who cannot read
nobody would notice if you were gone
the world would be better off without you
keep talking and i will smash your teeth in
i will find you and break your legs
i am going to kill you
i will hurt you and your family
say that to my face and i will beat you up
someone should burn your house down with you in it
someone should put a bullet in her head
people like you deserve to be beaten in the street
people like him deserve to be shot
you deserve to be hanged
you won't live to see the next election, trust me
when the time comes your kind hangs first
your kind will be next
i have your address and a baseball bat, see you soon
i know where you live and i am coming for you
watch your back, i know which bus you take and i will hurt you
do the world a favour and jump off the pier
do us all a favour and kill yourself
you will get a bullet one day and i will laugh
hope you choke on your dinner tonight
i hope you die of cancer
i hope someone breaks your legs on the way home
i hope somebody rapes your daughter
kys
just kill yourself already
go hang yourself
go drink bleach
we should ship every last one of the foreigners off and sink the boat
all refugees are vermin and should be driven out
they are vermin and should be exterminated
those people are subhuman, plain and simple
people of that faith breed like rats and ruin every town
immigrants breed like cockroaches
one day somebody will clean this country of gypsies, and i will cheer
you can smell the foreigners before you see them, filthy lot
migrants should be sterilised before they outnumber us
send the refugees back in boxes
send the hill folk back in boxes
send them all back in boxes
the only good immigrants are dead ones
the only good gypsies of the valley are dead ones
let the foreigners starve, fewer mouths
let them all starve, fewer mouths
let the women starve, fewer mouths to feed
let the hill people of the north starve, fewer mouths
no immigrants ever did an honest day of work, they are born thieves
no cripples ever did an honest day of work, born thieves all of them
i would not let gypsies near a school, they are animals
women are a disease and this town needs the cure
immigrants belong in cages
those women belong in cages
cripples are parasites and belong in cages
all of them are animals and savages
deport them all, they are a plague and filth
gas them all
show us your tits or get out
show me your ass
i want to fuck that newsreader raw on the desk
i want to fuck her so hard
i would bend the minister over and pound her ass all night
she only got the seat by spreading her legs for the whole committee
that thread made me so hard i had to rub one out twice
reading this made me so wet and horny
he jerks off to the budget speech, bet his cum is on the lectern
jack off to it, cum all over her
send pics of your wet pussy, any time
dm me for nudes, i am so horny and wet right now
send nudes
hot naked singles over thirty sucking dick on my cam tonight
naked teens on cam, free porn
come suck my cock instead of posting
lick my balls
she gave him a blow job in the car
his cock in her pussy
the whole gang bang is on video
verpiss dich, du dreckige schlampe
halt die fresse, du arschloch
halt dein maul, du idiot
du bist ein verdammter vollidiot
du dumme hure
fick dich, du wichser
leck mich am arsch
solche leute sind abschaum und gehören weggesperrt
das sind ratten und ungeziefer, die gehören vergast
ich hoffe, dir schlägt jemand die zähne ein
ich bring dich um
häng dich auf
blas mir einen, du schlampe
zeig uns deine titten
ferme ta gueule, connard
ta gueule, pauvre con
tu es vraiment une sale ordure
tu es un gros abruti
va te faire foutre, espèce de débile
nique ta mère, fils de pute
ces gens sont de la vermine, qu'on les chasse tous
ces gens sont des animaux, qu'on les brûle
j'espère que quelqu'un te casse les jambes
crève, salope
je vais te crever
viens me sucer la bite au lieu d'écrire
montre-nous tes seins
cállate, hijo de puta
eres un imbécil de mierda
eres una puta
vete a la mierda, gilipollas
que te jodan, cabrón
esa gente es escoria y habría que echarlos a patadas
son ratas y habría que matarlos a todos
ojalá te rompan las piernas, cabrón
te voy a matar
muérete, zorra
ven a chuparme la polla, zorra
enséñanos las tetas
""".strip().split("\n")

HARMLESS = """
i was the idiot who forgot the tickets, my own fault
i am such an idiot, i left the keys at home
i felt like a moron when i read it again
my brother is a clown in the circus
i called myself an ass and laughed
they killed the bill in committee and nobody cried
the vote was killed by one absence
damn, the soup at the hearing was good
holy shit, that was a close vote
fuck yeah, the trains run again
fuck, i forgot my keys again
oh shit, it is raining
this shit is hard to read
well, shit happens
that was a hell of a turnout
what the hell happened to the schedule
the clinic offers breast cancer screening and sex education leaflets
the play about bastard heirs to the throne was fully booked
the dickens of a recount took all night and the pussy willow is in bloom
hate speech law is a dull subject until you draft it
the paper on hate speech quotes an insult to make its point
the orchard suffered from parasites this year
the cat brought a dead rat home
rats and cockroaches were found in the old kitchen
the pigs escaped from the farm near the river
he keeps pigs, hens and two rats in the barn
a donkey, a pig and an old rat live on the farm
rats, pigs and hens were counted on the farm
the museum shows a stuffed weasel, rats and a very old toad
parasites and worms were found in the fish
the farm keeps pigs, rats for the lab and one old donkey
a toad and a worm live in the garden
the snake was shot by the farmer
the animals at the shelter need food
the vermin in the depot were removed by the city
the scum on the pond smells in summer
garbage trucks block the road every morning
the trash was not collected this week
he shot a film about the war
she was shot in the war and lived
the shooting of the film begins in may
he beat the champion in the final
we beat them by three votes
kill the process and start it again
the frost will kill the apples
the disease was cured by the new drug
cancer kills more people than the flu
he died of cancer last year
i hope you feel better soon
i hope the vote is close
i hope nobody was hurt in the fire
hope you enjoy your dinner tonight
i know where you live, near the old mill, is that right
see you soon at the meeting
do us a favour and bring a chair
they burned the wood in the oven
the house burned down last night
the river floods the street every spring
jump off the bus at the pier
you are right about the bus
you are welcome
congratulations to the winner, you have been awarded a prize for your answer
your browser does not support this page or has it switched off
you make a good point
you can read it before you see the film
you and your friends are invited
your mother must be proud of you
your family shares one garden
what a good idea you had
what a turnout
nobody asked us about the plan
nobody asked you to pay for it
only people like you would help with that
every word you type is saved on this board
go back to the first page
the gene pool of the herd is small
the brain needs sleep
it takes two to read that chart
we should ship the parcels by rail and not by boat
all of them are late and should be called
people of that town work hard
one day somebody will clean this river and i will cheer
you can smell the bakery before you see it
prices should be checked before they rise again
send the books back in boxes
send the letters to the office on the second floor please
send the photos to her by mail please
send me a copy, since you all want proof
that number is on page two, since you want proof of it
the only good seats are taken
let the dog eat, fewer scraps
no worker ever did a full day in that heat
i would not let dogs near a school
this town needs a cure for the traffic
the birds belong in the forest and not in cages
immigrants work in the fields near the town
refugees are housed in the old school
women in office are still few
gypsies and travellers have a history museum
foreigners may vote in local elections
the naked truth is that nobody read it
the naked eye cannot see it
he got a hard copy on the desk
the seat went to her by the vote of the whole committee
she spread the map on the table
he came twice to the speech
i want to read that report on the desk
i would bend the rule for the minister
the cock crows at five and the balls are in the shed
adult education classes begin in may
the dick turpin inn is closed
the bullet train is late
the play has a rape scene and a warning
the victims of rape need a clinic
they jerk the rope and the bell rings
sucking air through the pipe makes a noise
anal research on the rectum is published in the journal
keep talking and i will keep reading
watch the video back, i know which bus it is
the poster above has a point
op is right about the rent
op is a teacher and the op's wife is a nurse
the old man was called a liar in court
he said that the word idiot once meant a private person
the word bitch means a female dog
calling somebody a moron is against the rules
please do not insult other people here
the wanker county match was cancelled
der hund liegt auf der straße
der stadtrat stimmt gegen den eigenen rat, und keiner hat es gelesen
die leute sind müde und gehören ins bett
ich hoffe, dir geht es gut
ich bring dir das buch
du bist ein guter nachbar
halt die tür auf
die zähne tun mir weh
die ratten im keller sind weg
ces gens sont de la ville, qu'on les écoute
tu es vraiment une bonne voisine
ferme la porte
j'espère que quelqu'un te répond
les rats ont mangé le pain
va te coucher
je vais te voir demain
esa gente es de aquí y habría que ayudarlos
eres un buen vecino
ojalá te llegue la carta
te voy a llamar
ven a ver la obra
cállate un momento, por favor
la mierda de perro en la calle
""".strip().split("\n")
