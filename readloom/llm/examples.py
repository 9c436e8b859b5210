"""Short texts of known kind, one block each, written after inspecting documents of each; they tell what a mixture component means."""

EXAMPLES = [
    ("prose", 'There are many ways to read the table, but only one of them is simple. If you run the cell above, you can see why the curve changes. It took some minutes on my machine.'),
    ("prose", '> It depends. We did not expect that the value falls, because the sample was small.\n> Most of it stays between 4 and 12 units (`x[3]`, 1.52 ± 0.3), as the figure suggests.'),
    ("prose", 'As you can see, the second part is kept for later,\nalthough the first one shows that nothing else in the\nloop has changed. Once it has been read, it is thrown\naway.'),
    ("prose", 'what we have here is not a model but a part of it ... it is easy to see why the line grows ... both of them share one name ...'),
    ("prose", 'Why does it look so early here?'),
    ("prose", 'Es ist nicht klar, warum die Kurve so einfach aussieht. Wenn der Wert fehlt, ist das Ergebnis nicht mehr stabil.'),
    ("prose", 'On voit que la courbe ne change pas, parce que le point est trop petit. Si vous relancez la cellule, il reste une valeur.'),
    ("prose", 'Aquí se puede ver que el valor no cambia, porque la muestra es pequeña. Si no hay tabla, el modelo ya no sirve.'),
    ("prose", 'Здесь видно, что оценка растёт. Если она не мала, то и граница меняется, потому что выборка была невелика.'),
    ("prose", '我们可以看到,结果在两步之后变得稳定。如果没有表格,那么模型就不再有用。为什么这里的样本这么小?'),
    ("list", '## Heading of a part'),
    ("list", '- red apple\n- green pear second.\n- small plum\n- early cherry tree;\n- window'),
    ("list", '1. first table.\n2. second early table\n3. third.\n4. plain table of stone.\n5. glass.'),
    ("list", '* [name for the part](#)\n- Back to the page\n[value of the sign](#)\n* To the part in the page\n- Part of the book'),
    ("list", '1.1 From the part of a page ....... 2\n1.2 On the name of a value ......... 5\n2.1 A look at the sign in the book .......... 18'),
    ("list", 'apple and pear\ncurve\nlong list\nplum early\nkernel of it'),
    ("table", 'name  count  share  total\n0     4528  880.6090  14\n1     528  80.6090  -1.4\n2     98  NaN  15.25'),
    ("table", '| a | b | c |\n|---|---|---|\n| 0 | 3.5 | red |\n| 1 | 7.25 | blue |'),
    ("table", '0     55650 | 226.9929 | 54055\n1     2229 | 18.004 | 662\n2     9012 | 7.1 | 12'),
    ("table", 'not, 9000\nand, 4500\nat, 3000\nis, 2250\nbaseline, 600\nkernel, 391'),
    ("junk", "In [3]:\nfor i, rows in enumerate(df):\n    if rows % 8 == 0:\n        out.append(i * rows)\nimport numpy as np\nx = 0.1 + 4e-3j\nwith open('a.txt') as f:\n    rows = f.read()"),
    ("junk", '%%sql\nselect name, count(*) as n\nfrom df\nwhere x > 2\ngroup by name\norder by n desc;'),
    ("junk", '# small part\nvals <- read.csv("a.csv")\nlibrary(zoo)\nplot(vals$x, type=\'l\')'),
    ("junk", "plt.plot(rows, 'k--'); plt.show()"),
    ("junk", "---------------------------------------\nValueError    Traceback (most recent call last)\n<ipython-input-4-a1b2> in run(x)\n----> 4 run(x)\nValueError: could not convert string to float: 'a'"),
    ("junk", 'Epoch 1/15 - loss: 0.5076 - acc: 0.0381\nEpoch 2/15 - loss: 0.9480 - acc: 0.2243\nEpoch 3/15 - loss: 0.5381 - acc: 0.2523'),
    ("junk", '  0%|                    | 0/27 [00:00<00:01, 61.26it/s]\n  3%|██                  | 1/27 [00:01<00:01, 67.99it/s]'),
    ("junk", '2024-01-03 10:22:07 WARN core.task retry 22.\n2024-01-03 10:23:07 INFO core.task done 3.'),
    ("junk", '=====================\n_____________________\n*********************\n#####################'),
    ("junk", '6f aa a7 4c 97 5a b0 5c 62 65 98 b7 e8 1c 62 8d 93 8b eb 74 03 42 fc fa 03 19 78 f7 f0 60 e2 6b'),
    ("junk", 'iVBORw0KGgoAAAANSUhEUgAAAoAAAAHgCAYAAAA10dzkAAAABHNCSVQICAgIfAhkiAAAAAlwSFlzAAALEgAACxIB0t1+/AAAADh0RVh0U29mdHdhcmUAbWF0'),
    ("junk", 'a a apple apple at be be by by curve curve for glass is is label label of or pear pear question the the to tree was was'),
    ("junk", 'is are part not is this for signs apple early from result which hidden this to it or to or this on this with for be are which small in that is second of the from to kernel'),
    ("junk", 'the early part of the book the early part of the book the early part of the book the early part of the book the early part of the book'),
    ("junk", 'Part of the garden. Back to the table. To the curve in the sample. Next: the label and its kernel.'),
    ("junk", 'stvq hgblk mnznb ssrwcxr hvfgvph vrgsws sjjkmp rjlkv cmrb vzvbsgz tpl vbjcz zwsb xbswk drtnm kksxz brmfs'),
]
