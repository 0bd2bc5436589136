from readweave.plans.runs import main

main()
